"""Figures of a stage's result: exact order statistics of many columns at once, counts and shares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from platlark.functions.shared import staged

NEIGHBOURS = ["peers", "same_plat", "attached", "near_unplatted"]


@dataclass(frozen=True)
class SelectionParams:
    """``bins``: of a histogram; ``few``: values of an interval that need no finer one; ``rounds``: of refinement at most."""

    bins: int = 1024
    few: int = 100_000
    rounds: int = 8


def order_statistics(values: DataFrame, shares: list[float], params: SelectionParams = SelectionParams()) -> DataFrame:
    """(line, n, share, value): for each line the value at place floor(n * share) of its sorted values, counted from 0.

    values: line, v.  All lines and shares are found at once: a histogram of each line
    tells in which bin a place lies; those bins are cut again until few values are left, and
    these are counted out.  Only counts of bins are ever sorted, line by line.  Nulls and not-a-numbers do not count.
    """
    v = values.select("line", F.col("v").cast("double").alias("v")).filter("v is not null and not isnan(v)")
    v = staged(v, "figures")
    asked = v.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    share = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    # ``rank``: how many values of the interval come before the place; ``inside``: values of the interval
    asked = asked.select("line", "n", share, "lo", "hi", F.col("n").alias("inside")).withColumn("rank", F.least(F.floor(F.col("n") * F.col("share")), F.col("n") - 1))
    asked = staged(asked, "places")
    key = ["line", "share"]
    for _ in range(params.rounds):
        open_ = (F.col("inside") > params.few) & (F.col("hi") > F.col("lo"))
        if not asked.filter(open_).head(1):
            break
        b = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * params.bins), F.lit(params.bins - 1))
        inner = v.join(F.broadcast(asked.filter(open_)), "line").filter("v between lo and hi")
        bins = inner.groupBy(*key, b.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("bin_lo"), F.max("v").alias("bin_hi"))
        upto = F.sum("c").over(W.partitionBy(*key).orderBy("bin"))
        found = bins.withColumn("upto", upto).join(asked.select(*key, "rank"), key).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
        found = found.select(*key, (F.col("rank") - F.col("upto") + F.col("c")).alias("new_rank"), "bin_lo", "bin_hi", "c")
        pick = lambda new, old: F.coalesce(F.col(new), F.col(old)).alias(old)
        asked = staged(asked.join(found, key, "left").select(*key, "n", pick("new_rank", "rank"), pick("bin_lo", "lo"), pick("bin_hi", "hi"), pick("c", "inside")), "places")
    same = asked.filter("hi = lo").select("line", "n", "share", F.col("lo").alias("value"))
    rest = v.join(F.broadcast(asked.filter("hi > lo")), "line").filter("v between lo and hi")
    counted = rest.groupBy(*key, "n", "rank", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.partitionBy(*key).orderBy("v"))
    exact = counted.withColumn("upto", upto).filter("upto > rank").groupBy("line", "n", "share").agg(F.min("v").alias("value"))
    return same.unionByName(exact)


def spread(values: DataFrame) -> DataFrame:
    """(line, n, median, p90, max) of ``values`` (line, v), by position in the sorted list."""
    at = order_statistics(values, [0.5, 0.9, 1.0])
    of = lambda s: F.max(F.when(F.col("share") == s, F.col("value")))
    return at.groupBy("line").agg(F.max("n").alias("n"), of(0.5).alias("median"), of(0.9).alias("p90"), of(1.0).alias("max"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def _lines(counts: DataFrame, **figures: Column) -> DataFrame:
    """(line, value) of a one-row table."""
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("line"), v.cast("double").alias("value")) for k, v in figures.items()])))


def neighbour_counts(contexts: DataFrame) -> DataFrame:
    """``contexts`` with the sizes of their neighbour lists instead of the lists."""
    return contexts.withColumns({c: F.size(c) for c in NEIGHBOURS})


def context_spread(contexts: DataFrame) -> DataFrame:
    """(line, n, median, p90, max) over the analysed places: neighbours of each kind and together, and the confidence.

    contexts: analysed, confidence and a count for each kind of neighbour.
    """
    c = contexts.filter("analysed")
    total = sum((F.col(x) for x in NEIGHBOURS[1:]), F.col(NEIGHBOURS[0]))
    lines = [*[F.struct(F.lit(x).alias("line"), F.col(x).cast("double").alias("v")) for x in NEIGHBOURS], F.struct(F.lit("total").alias("line"), total.cast("double").alias("v")), F.struct(F.lit("confidence").alias("line"), F.col("confidence").cast("double").alias("v"))]
    return spread(c.select(F.inline(F.array(*lines))))


def context_figures(contexts: DataFrame) -> DataFrame:
    """(line, value): analysed places, those with a naming plat, those that more than one plat could have named, and how unsure."""
    c = contexts.filter("analysed").agg(
        F.count(F.lit(1)).alias("n"), F.count("naming_plat").alias("named"), F.count_if(F.col("contenders") > 1).alias("open"),
        F.count("confidence").alias("judged"), F.count_if(F.col("confidence") < 0.5).alias("unsure"),
    )
    n = F.col("n")
    return _lines(
        c, analysed=n, named=F.col("named"), named_share=_ratio(F.col("named"), n), several_plats=F.col("open"), several_plats_share=_ratio(F.col("open"), n),
        under_half_share=_ratio(F.col("unsure"), F.col("judged")),
    )


def candidate_figures(found: DataFrame, kept: DataFrame) -> DataFrame:
    """(line, value): cores and candidates before and after filtering, and what was dropped; both tables: core and a row for each candidate."""
    both = found.select("core", F.lit(False).alias("left")).unionByName(kept.select("core", F.lit(True).alias("left")))
    c = both.agg(
        F.count_distinct(F.when(~F.col("left"), F.col("core"))).alias("cores"), F.count_distinct(F.when(F.col("left"), F.col("core"))).alias("cores_left"),
        F.count_if(~F.col("left")).alias("n"), F.count_if("left").alias("n_left"),
    )
    dropped = F.col("n") - F.col("n_left")
    return _lines(c, cores=F.col("cores"), cores_left=F.col("cores_left"), candidates=F.col("n"), left=F.col("n_left"), dropped=dropped, dropped_share=_ratio(dropped, F.col("n")))


def layer_figures(streets: DataFrame, answers: DataFrame, known: list[str]) -> DataFrame:
    """(line, value) of a street layer: features, answered ones, answers without a shape, subdivisions, and features of unknown categories."""
    drawn = streets.select("place", F.lit(True).alias("drawn"), (F.col("status") == "answered").alias("answered"), (F.col("subdivision") != "").alias("named"), (~F.col("category").isin(known)).alias("odd"))
    read = answers.select("place").distinct().withColumn("read", F.lit(True))
    c = drawn.join(read, "place", "full").agg(*[F.count_if(x).alias(x) for x in ("drawn", "answered", "named", "odd", "read")], F.count_if(F.col("read") & F.col("drawn").isNull()).alias("lost"))
    return _lines(
        c, answers=F.col("read"), features=F.col("drawn"), answered=F.col("answered"), not_asked=F.col("drawn") - F.col("answered"), answered_without_shape=F.col("lost"),
        with_subdivision=F.col("named"), without_subdivision=F.col("drawn") - F.col("named"), unknown_category=F.col("odd"),
    )


def dump(contexts: DataFrame, core: Column) -> DataFrame:
    """(line, text): the first place of a core as a reader wants it, its plats and its neighbours by name."""
    place = contexts.filter(F.col("core") == core).orderBy("place_id").limit(1)
    head = place.select(F.lit("0").alias("line"), F.format_string("%s  [%s]  analysed=%s", "name", "place_id", F.col("analysed").cast("string")).alias("text"))
    p = place.select("street_m", F.posexplode("plats").alias("i", "p"))
    plats = p.select(
        F.format_string("1.%06d", "i").alias("line"),
        F.format_string(
            "plat %s %s inside %.0f of %.0f m run %.0f claim %.2f%s", F.left("p.name", F.lit(26)), F.coalesce(F.year("p.recorded").cast("string"), F.lit("????")),
            F.col("p.inside_m").cast("double"), F.col("street_m").cast("double"), F.col("p.run_m").cast("double"), F.col("p.claim").cast("double"), F.when(F.col("p.material"), " MATERIAL").otherwise(""),
        ).alias("text"),
    )
    names = contexts.select(F.col("place_id").alias("other"), F.col("name").alias("other_name"))
    out = head.unionByName(plats)
    for k, c in enumerate(NEIGHBOURS):
        n = place.select(F.lit(f"{k + 2}").alias("line"), F.format_string("%s (%d)", F.lit(c), F.size(c)).alias("text"))
        near = place.select(F.posexplode(F.slice(c, 1, 25)).alias("i", "other")).join(names, "other").select(F.format_string(f"{k + 2}.%06d", "i").alias("line"), F.concat(F.lit("    "), "other_name").alias("text"))
        out = out.unionByName(n).unionByName(near)
    return out.orderBy("line")
