"""Mixing sources to target weights by Poisson replication, natively.

Each source has a mean repetition rate: its target share of the mixture's
characters over its own.  A document's count is drawn from a Poisson distribution
with that mean by inverting it at a uniform number hashed from id and seed; the
document is exploded by its count, and all copies are put in the order of an MD5 of
(id, copy), a global shuffle that any rerun repeats.  As the hashes are uniform, their
leading bits name the partition directly: one exchange, without a sample of the rows.

Rates are staged and counted: up to ``FEW`` sources they are broadcast; beyond that
each source's row is copied to ``SALTS`` keys, so that no source meets in one task.

A large rate is drawn as the sum of several draws of mean ``STEP`` at most, so the
table of the distribution has ``TERMS`` entries whatever the rate.

Defined results
* null text has no characters, a null source is a source of its own.
* a source whose texts are all empty has the rate 1.
* weights that name no source are ignored; sources without a weight get the rate 0
  when weights are given.
* rows repeated under one id get the same count; rows without an id are drawn and placed
  by an MD5 of their texts, so different texts are drawn apart.
* extra columns are carried; ``copy`` and ``shuffle_key`` replace columns of those
  names.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from platlark.functions.shared import staged

STEP, TERMS = 8.0, 64
FEW, SALTS = 5_000, 64


def uniform(doc_id: Column, *salts) -> Column:
    """In [0, 1): the first 52 bits of an MD5 of the id and the salts."""
    text = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), *[s if isinstance(s, Column) else F.lit(str(s)) for s in salts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def drawn_by(doc_id: Column, text: Column) -> Column:
    """What a row's draws and places follow: its id, or its text's MD5 where it has none."""
    return F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def rates(docs: DataFrame, source: str, text: str, weights: dict[str, float] | None, exponent: float, epochs: float) -> DataFrame:
    """(__m_source, rate): target share times all characters over the source's own."""
    size = docs.groupBy(F.col(source).alias("__m_source")).agg(
        F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).cast("double").alias("size")
    )
    if weights is None:
        goal = F.pow("size", exponent)
    else:
        pairs = [F.when(F.col("__m_source") == k, F.lit(float(v))) for k, v in weights.items()]
        goal = F.coalesce(*pairs, F.lit(0.0))
    size = staged(size, "sizes").withColumn("goal", goal)
    all_size, all_goal = size.agg(F.sum("size"), F.sum("goal")).first()
    share = F.col("goal") / float(all_goal or 1.0)
    rate = F.when(F.col("size") > 0, share * float(epochs * (all_size or 0.0)) / F.col("size")).otherwise(F.lit(1.0))
    return size.select("__m_source", rate.alias("rate"))


def _distribution(rate: Column) -> Column:
    """P(N <= 0), P(N <= 1), ... of the Poisson distribution with this mean."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(s, k):
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.array_append(s["all"], s["c"] + p).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda s: s["all"])


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: dict[str, float] | None = None,
    exponent: float = 0.5,
    epochs: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """Copies of the rows of ``docs`` with ``copy`` (from 1) and ``shuffle_key``, in shuffled order.

    weights: target share of the characters for each source; without them a
    source's share grows as its size to the power ``exponent``.  epochs: size of the
    mixture over the size of the input.
    """
    table = rates(docs, source, text, weights, exponent, epochs)
    table = table.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int"))
    table = table.withColumn("__m_cdf", _distribution(F.col("rate") / F.col("draws"))).drop("rate")
    table = staged(table.withColumnRenamed("draws", "__m_draws"), "rates")
    kept = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(source).alias("__m_own"), drawn_by(F.col(doc_id), F.col(text)).alias("__m_id"))
    own = F.col("__m_own").eqNullSafe(F.col("__m_source"))
    if table.count() <= FEW:
        rows = rows.join(F.broadcast(table), own)
    else:
        rows = rows.withColumn("__m_salt", F.pmod(F.xxhash64("__m_id"), F.lit(SALTS)))
        table = table.withColumn("__m_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.join(table, own & (F.col("__m_salt") == F.col("__m_to")))
    one = lambda j: F.size(F.filter("__m_cdf", lambda c: c <= uniform(F.col("__m_id"), seed, j.cast("string"))))
    count = F.aggregate(F.sequence(F.lit(1), F.col("__m_draws")), F.lit(0), lambda acc, j: acc + one(j))
    rows = rows.withColumn("__m_n", count).filter("__m_n > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__m_n"))))
    key = F.md5(F.concat_ws(":", F.col("__m_id"), F.lit(f"{seed}:order"), F.col("copy").cast("string")))
    rows = rows.withColumn("shuffle_key", key)
    place = F.col("shuffle_key")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.conv(F.substring(place, 1, 8), 16, 10).cast("double") * n / float(1 << 32)).cast("int")
    rows = rows.select(*[F.col(f"`{c}`") for c in kept], "copy", "shuffle_key", place.alias("__m_place"), part.alias("__m_part"))
    return rows.repartitionById(n, "__m_part").sortWithinPartitions("__m_place", "copy").drop("__m_place", "__m_part")
