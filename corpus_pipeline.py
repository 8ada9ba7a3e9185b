"""Training-corpus pipeline over ``documents``: five operator stages in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from platlark.llm import mixing, native_quality, neardup, packing, spans


def _aside(docs: DataFrame, names: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` over ``docs``; columns of ``docs`` that bear the stage's own names step aside and come back unchanged."""
    own = {c: f"__own_{c}" for c in docs.columns if c in names}
    out = stage(docs.withColumnsRenamed(own)).drop(*names)
    return out.withColumnsRenamed({v: k for k, v in own.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, each judged alone.

    Null and empty texts have no words and go; null or repeated ids are judged by their
    texts; without labelled good documents only the base rules decide; an empty table
    stays empty; all columns are carried, whatever their names.
    """
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    return native_quality.keep_good(docs, trusted)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    The smallest id stays, of equal rows one; null texts count as empty ones, which are
    alike; rows without an id stay; all columns are carried, whatever their names.
    """
    return neardup.deduplicate(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are taken out of all documents but the first; ``n_chars`` follows the text.

    No row goes, even if nothing of its text is left; null texts stay null; rows of one
    id are documents of their own; rows without an id are left as they are; own columns named
    ``n_sentences`` or ``n_removed`` are carried unchanged.
    """
    out = _aside(docs, ("n_sentences", "n_removed"), spans.remove_repeats)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents by their source's rate, in a shuffled order.

    A null source is a source of its own, one without any text has the rate 1; rows
    without an id are drawn by their texts; own columns named ``copy`` or ``shuffle_key`` are carried unchanged.
    """
    return _aside(docs, ("copy", "shuffle_key"), mixing.mix)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in fixed-length sequences.

    A null text is one end id; repeated rows and null ids are packed like any other;
    only the place columns are returned.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("source mixing", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: Fitted statistics, fingerprint graphs and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet in the shared folder and read again."""
    from platlark.functions.shared import staged

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"stage{k + 1}")
    return docs
