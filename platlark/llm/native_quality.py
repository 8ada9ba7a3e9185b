"""Quality rules: base text rules plus a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are fitted: one on a
trusted target set, one on the whole raw corpus.  A document's score is the mean
log ratio of its n-grams (so it does not depend on length), and every document
gets a verdict by one fixed threshold.  Everything here is DataFrame
expressions; no Python runs on the executors.

The trusted rows are the labelled good documents; at most
``QualityParams.max_trusted`` of them (those with the smallest id hashes) are
used, which bounds the broadcast list of ids.  The raw multinomial always covers
every row.

Defined results
* null text is the empty text: no words, the base rules fail, not kept.
* null or repeated ids are carried through; each row is judged alone.
* no trusted rows, or an empty corpus: a flat ratio of 0.0, so only the base
  rules decide.
* a score equal to the threshold is kept.
* extra columns of the input are carried by ``keep_good``; internal columns start
  with ``__q_`` and never leave the operator.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SYMBOLS = "[#*$%&|<>]"
#: Bits of a window's number; a text has fewer than 2 ** 31 characters, so under 2 ** 30 words.
PLACE = 30


@dataclass(frozen=True)
class QualityParams:
    """``buckets`` (a power of two) bounds both multinomials and what reaches the driver.

    ``smoothing`` pseudo-counts pull each bucket's target count towards what the
    raw corpus leads one to expect, so rare n-grams say little either way.
    """

    buckets: int = 65536
    smoothing: float = 10.0
    threshold: float = -0.06
    max_trusted: int = 50_000
    min_words: int = 50
    max_repeat_percent: int = 50


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x09-\\x0D]", " ")
    return F.array_remove(F.split(spaced, " "), "")


def _beside(h: Column) -> Column:
    """A hash for each two neighbours of an array of hashes."""
    n = F.greatest(F.size(h) - 1, F.lit(0))
    return F.zip_with(F.slice(h, 1, n), F.slice(h, F.lit(2), n), lambda a, b: F.xxhash64(a, b))


def _numbered(h: Column) -> Column:
    """The upper bits of each hash and, in the lower ``PLACE``, its number."""
    return F.transform(h, lambda x, i: F.shiftleft(x, PLACE).bitwiseOR(i.cast("long")))


def with_base(docs: DataFrame, text: str, params: QualityParams) -> DataFrame:
    """Adds ``__q_w``, ``__q_hashes`` (of words), ``__q_pairs`` and the base columns of the rules.

    Repeated 3-word windows: only where two window hashes of a text agree, each
    window's number is joined to bits of its hash in one long; sorted, windows of
    equal bits stand side by side.  Only those are spelled out, followed by their positions, and sorted again, so that equal
    windows stand side by side; the sorted positions of repeated ones give the
    covered words, each window adding those that the one before has not covered.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    gram = lambda k: F.substring_index(k, " ", 3)
    bits, keyed, at = F.col("__q_bits"), F.col("__q_keyed"), F.col("__q_at")
    w, n, pairs = F.col("__q_w"), F.col("n_words"), F.col("__q_pairs")
    beside = lambda k, i: gram(k) == gram(F.coalesce(F.get(keyed, i), F.lit("")))
    near = lambda x, i: F.shiftright(F.get(bits, i), PLACE) == F.shiftright(x, PLACE)
    out = docs.withColumns(
        {
            "__q_w": words(F.col(text)),
            "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
            "__q_lines": lines,
        }
    ).withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_dup_lines": (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"),
            "__q_hashes": F.transform(w, lambda x: F.xxhash64(x)),
        }
    )
    out = out.withColumn("__q_pairs", _beside(F.col("__q_hashes")))
    out = out.withColumn("__q_windows", _beside(pairs))
    repeats = F.size(F.array_distinct("__q_windows")) < F.size("__q_windows")
    bits_of = F.sort_array(_numbered(F.col("__q_windows")))
    out = out.withColumn("__q_bits", F.when(repeats, bits_of).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn(
        "__q_twins",
        F.transform(
            F.filter(bits, lambda x, i: near(x, i - 1) | near(x, i + 1)), lambda x: x.bitwiseAND((1 << PLACE) - 1).cast("int")
        ),
    )
    out = out.withColumn(
        "__q_keyed",
        F.sort_array(
            F.transform(
                F.col("__q_twins"),
                lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2), F.lpad(i.cast("string"), 10, "0")),
            )
        ),
    )
    out = out.withColumn(
        "__q_at",
        F.sort_array(
            F.filter(
                F.transform(keyed, lambda k, i: F.when(beside(k, i - 1) | beside(k, i + 1), F.substring_index(k, " ", -1).cast("int"))),
                lambda x: x.isNotNull(),
            )
        ),
    )
    step = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
    out = out.withColumn("n_repeat_words", F.aggregate(step, F.lit(0), lambda acc, x: acc + x).cast("long"))
    return out.withColumn(
        "base_failed",
        (n < params.min_words) | (100 * F.col("n_repeat_words") > params.max_repeat_percent * n),
    ).drop("__q_lines", "__q_windows", "__q_bits", "__q_twins", "__q_keyed", "__q_at")


def double_array(spark: SparkSession, values: list[float]) -> Column:
    """An array literal, handed to the JVM as one buffer instead of value by value."""
    jvm = spark._jvm
    out = spark.sparkContext._gateway.new_array(jvm.double, len(values))
    jvm.java.nio.ByteBuffer.wrap(struct.pack(f">{len(values)}d", *values)).asDoubleBuffer().get(out)
    return Column(jvm.org.apache.spark.sql.functions.lit(out))


def _bucket(h: Column, params: QualityParams) -> Column:
    return h.bitwiseAND(params.buckets - 1).cast("int")


def fit(docs: DataFrame, trusted_ids: DataFrame, doc_id: str, text: str, params: QualityParams) -> list[float]:
    """Log ratio for each bucket, target over raw, from one pass over every text.

    ``trusted_ids`` has one column of ids; the ``max_trusted`` ones with the
    smallest hashes are broadcast.  The exploded buckets are counted map-side, so
    at most ``buckets`` rows a task are shuffled and ``buckets`` reach the driver.
    """
    ids = trusted_ids.select(F.col(trusted_ids.columns[0]).alias("__q_id")).dropna().distinct()
    ids = ids.orderBy(F.xxhash64("__q_id"), "__q_id").limit(params.max_trusted).withColumn("__q_good", F.lit(1))
    h = F.col("h")
    rows = docs.select(F.col(doc_id).alias("id"), F.transform(words(F.col(text)), lambda x: F.xxhash64(x)).alias("h")).join(
        F.broadcast(ids), F.col("id") == F.col("__q_id"), "left"
    )
    counts = (
        rows.select(F.coalesce("__q_good", F.lit(0)).alias("good"), F.explode(F.concat(h, _beside(h))).alias("h"))
        .groupBy(_bucket(F.col("h"), params).alias("b"))
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("target"))
        .collect()
    )
    raw = sum(r["raw"] for r in counts)
    target = sum(r["target"] for r in counts)
    out = [0.0] * params.buckets
    if not target:
        return out
    for r in counts:
        expected = r["raw"] * target / raw
        out[r["b"]] = math.log((r["target"] + params.smoothing) / (expected + params.smoothing))
    return out


def score(docs: DataFrame, ratios: list[float], text: str, params: QualityParams) -> DataFrame:
    """``docs`` with the base columns, ``llr`` (mean log ratio) and ``kept``."""
    table = double_array(docs.sparkSession, ratios)
    words_, pairs = F.col("__q_hashes"), F.col("__q_pairs")
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda acc, x: acc + F.get(table, _bucket(x, params)))
    out = with_base(docs, text, params)
    n = F.size(words_) + F.size(pairs)
    out = out.withColumn("llr", F.when(n > 0, (total(words_) + total(pairs)) / n).otherwise(F.lit(0.0)))
    kept = ~F.col("base_failed") & (F.col("llr") >= params.threshold)
    return out.withColumn("kept", kept).drop("__q_w", "__q_hashes", "__q_pairs")


def quality(docs, trusted_ids, doc_id="doc_id", text="text", params: QualityParams = QualityParams()) -> DataFrame:
    """One row per document: id, base columns, score and verdict."""
    scored = score(docs.select(doc_id, text), fit(docs, trusted_ids, doc_id, text, params), text, params)
    return scored.select(
        doc_id, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"
    )


def keep_good(docs, trusted_ids, doc_id="doc_id", text="text", params: QualityParams = QualityParams()) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("__q_row"), F.col(text).alias("__q_text"))
    ratios = fit(docs, trusted_ids, doc_id, text, params)
    # the row number keeps the optimizer from copying the whole verdict into the scan's filter
    judged = score(rows, ratios, "__q_text", params).withColumn("__q_n", F.monotonically_increasing_id())
    return judged.filter(F.col("kept") & (F.col("__q_n") >= 0)).select("__q_row.*")
