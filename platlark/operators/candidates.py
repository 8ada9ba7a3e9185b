"""Knowledge-base candidates: which items could be a referent, and what is still to search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from platlark.functions import names as N

# Classes of items that are bare names or bookkeeping pages.
EXCLUDE_TYPES = [
    "Q101352", "Q202444", "Q12308941", "Q11879590", "Q3409032", "Q1243157", "Q66480858", "Q60558422", "Q4167410",
    "Q4167836", "Q13406463", "Q17362920", "Q82799", "Q829026", "Q56219051", "Q98775491", "Q1130279", "Q11455398",
    "Q333021", "Q17143070", "Q1714800", "Q19914123", "Q1093580", "Q18972207", "Q108709", "Q8436",
]
# Parts of descriptions, and whole descriptions, of bare names.
REJECT_PARTS = ["family name", "given name", "male name", "female name", "surname", "wikimedia", "disambiguation"]
REJECT_WHOLE = ["family", "name", "personal name"]


def claim_types(claims: DataFrame) -> DataFrame:
    """(qid, types): classes of each item; claims: item and type IRIs, type null or empty where there is none."""
    c = claims.select(N.last_segment(F.col("item")).alias("qid"), F.nullif(N.last_segment(F.col("type")), F.lit("")).alias("t"))
    return c.groupBy("qid").agg(F.array_sort(F.collect_set("t")).alias("types"))


def bare_name(types: Column, description: Column) -> Column:
    """Whether an item could only say "named after someone".

    Every class must be excludable; an item without classes is judged by its
    description, and one without either is kept.
    """
    d = F.lower(F.trim(F.coalesce(description, F.lit(""))))
    by_words = d.isin(REJECT_WHOLE) | F.exists(N.strings(REJECT_PARTS), lambda s: F.contains(d, s))
    known = F.coalesce(F.size(types), F.lit(0)) > 0
    return F.when(known, F.size(F.array_except(types, N.strings(EXCLUDE_TYPES))) == 0).otherwise((d != "") & by_words)


def publishable(candidates: DataFrame, claims: DataFrame) -> DataFrame:
    """Candidates that could be a referent, renumbered within their core; cores left empty vanish."""
    from pyspark.sql import Window as W

    kept = candidates.join(claims, "qid", "left").filter(~bare_name(F.col("types"), F.col("description"))).drop("types")
    return kept.withColumn("pos", F.row_number().over(W.partitionBy("core").orderBy("pos")) - 1)


def emptied(candidates: DataFrame, kept: DataFrame) -> DataFrame:
    """Cores all of whose candidates were dropped."""
    return candidates.select("core").distinct().join(kept, "core", "left_anti")


def to_search(cores: DataFrame, cache: DataFrame) -> DataFrame:
    """Cores that the search cache does not hold yet (an empty hit list counts as held)."""
    return cores.join(cache.select("core").distinct(), "core", "left_anti")


def lettered(candidates: DataFrame) -> DataFrame:
    """The first ten candidates of each core with their letters."""
    return candidates.filter("pos < 10").withColumn("letter", F.substring(F.lit("ABCDEFGHIJ"), F.col("pos") + 1, F.lit(1)))


def lines(candidates: DataFrame) -> DataFrame:
    """(core, lines): the options of a core in letter order."""
    text = F.concat(
        F.lit("    - **"), "letter", F.lit(".** "), "label", F.lit(" — "),
        F.coalesce(F.nullif(F.col("description"), F.lit("")), F.lit("(no description)")),
    )
    made = F.array_sort(F.collect_list(F.struct("pos", text.alias("line"))))
    return lettered(candidates).groupBy("core").agg(F.transform(made, lambda s: s["line"]).alias("lines"))
