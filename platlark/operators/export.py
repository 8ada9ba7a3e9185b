"""Map layers: streets with their answers, and subdivisions with what they named."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from platlark.functions import geometry as G, names as N, platnames as P
from platlark.functions.shared import staged
from platlark.operators import overlay as O

ANSWER_FIELDS = ["qid", "label", "confidence", "theme", "reasoning"]
MIN_THEME_STREETS = 5
#: What a street's answer can be: a map that styles on these shows any other as unknown.
CATEGORIES = ["ENTITY", "INVENTED", "PERSONAL", "NONE", "NOT_ASKED"]


def rounded(points: Column, digits: int = 5) -> Column:
    """[[lon, lat], ...] to five decimals."""
    return F.transform(points, lambda p: F.array(N.round_half_even(p["lon"], digits), N.round_half_even(p["lat"], digits)))


def without_repeats(points: Column) -> Column:
    """A ring without points equal to the one before."""
    return F.filter(F.transform(points, lambda p, i: F.when((i == 0) | (p != F.get(points, i - 1)), p)), lambda p: p.isNotNull())


def streets(places: DataFrame, lines: DataFrame, answers: DataFrame, candidates: DataFrame, contexts: DataFrame) -> DataFrame:
    """One row per drawn street; every property is present, empty where nothing is known.

    lines: place_id, coordinates; places without any are not drawn.
    """
    has = candidates.select("core").distinct().withColumn("searched", F.lit(True))
    per_core = places.groupBy("core").agg(F.count(F.lit(1)).cast("int").alias("places_with_core"))
    a = answers.select(F.col("place").alias("place_id"), "choice", *ANSWER_FIELDS, F.lit(True).alias("asked"))
    c = contexts.select("place_id", "naming_phase", "naming_plat", "naming_phase_recorded", "naming_recorded")
    d = places.join(lines, "place_id").join(per_core, "core").join(a, "place_id", "left").join(has, "core", "left").join(c, "place_id", "left")
    year = N.iso_year(F.col("naming_recorded").cast("string"))
    text = lambda x: F.coalesce(x, F.lit(""))
    return d.select(
        F.col("place_id").alias("place"), F.col("name").alias("street"), "core", "places_with_core", *[text(F.col(f)).alias(f) for f in ANSWER_FIELDS],
        F.when(F.col("asked"), "answered").otherwise("not_asked").alias("status"),
        F.when(F.col("asked"), "").when(F.col("searched"), "not_in_a_run_yet").otherwise("no_wikidata_candidate").alias("not_asked_because"),
        text(F.col("naming_phase")).alias("subdivision"), text(F.col("naming_plat")).alias("subdivision_merged"), text(F.col("naming_phase_recorded")).alias("subdivision_recorded"),
        year.alias("plat_year"), F.when(year.isNull(), "").otherwise(N.era_of(year)).alias("plat_era"),
        category(F.col("asked"), F.col("qid"), F.col("choice")).alias("category"), "coordinates",
    )


def category(asked: Column, qid: Column, choice: Column) -> Column:
    return F.when(asked.isNull(), "NOT_ASKED").when(F.coalesce(qid, F.lit("")) != "", "ENTITY").otherwise(choice)


def legend(streets: DataFrame) -> DataFrame:
    """(field, value, n): streets by category and by era."""
    one = streets.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("category", "plat_era")])))
    return one.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def street_features(streets: DataFrame) -> DataFrame:
    """(place, feature): GeoJSON of each street."""
    props = F.struct(*[c for c in streets.columns if c != "coordinates"])
    shape = F.struct(F.lit("MultiLineString").alias("type"), F.col("coordinates"))
    return streets.select("place", F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), shape.alias("geometry"))).alias("feature"))


def one_theme(themes: list[str], words: list[list[str]]) -> str:
    """The theme that streets share: themes with a word in common are one; empty if a second one has three or more."""
    if len(themes) < MIN_THEME_STREETS:
        return ""
    groups: list[tuple[set[str], list[int]]] = []
    for k, own in enumerate(map(set, words)):
        hit = [g for g in groups if g[0] & own]
        members = sorted(i for g in hit for i in g[1])
        groups = [g for g in groups if g not in hit] + [(own.union(*(g[0] for g in hit)), [*members, k])]
    groups.sort(key=lambda g: (-len(g[1]), g[1][0]))
    if len(groups) > 1 and len(groups[1][1]) >= 3:
        return ""
    top = [themes[i] for i in groups[0][1]]
    return max(dict.fromkeys(top), key=top.count)


@F.pandas_udf(StringType())
def shared_theme(themes: pd.Series, words: pd.Series) -> pd.Series:
    return pd.Series([one_theme(list(t), [list(x) for x in w]) for t, w in zip(themes, words, strict=True)], dtype=object)


def themes(named: DataFrame) -> DataFrame:
    """(subdivision, theme); named: subdivision, place, theme."""
    n = named.filter(N.themed(F.col("theme")))
    n = n.groupBy("subdivision").agg(F.array_sort(F.collect_list(F.struct("place", "theme", N.theme_words(F.col("theme")).alias("w")))).alias("t"))
    n = n.withColumn("theme", shared_theme(F.transform("t", lambda x: x["theme"]), F.transform("t", lambda x: x["w"])))
    return named.select("subdivision").distinct().join(n.select("subdivision", "theme"), "subdivision", "left").select("subdivision", F.coalesce("theme", F.lit("")).alias("theme"))


def drawn(plats: DataFrame) -> DataFrame:
    """Plats that are still there: vacated and rescinded ones only count for naming."""
    return plats.filter(~F.col("name").rlike(P.VACATED))


def listed(rows: DataFrame, by: list[str], contexts: DataFrame, out: str) -> DataFrame:
    """``by`` and the place ids in the order of (core, name)."""
    d = rows.join(contexts.select("place_id", "core", F.col("name").alias("street")), "place_id")
    return d.groupBy(*by).agg(F.transform(F.array_sort(F.collect_set(F.struct("core", "street", "place_id"))), lambda x: x["place_id"]).alias(out))


def short_phase(full: Column, label: Column) -> Column:
    """The phase without its subdivision's name; the whole label where nothing is left."""
    rest = F.when(F.startswith(full, label), F.btrim(F.substr(full, F.length(label) + 1), F.lit(", "))).otherwise(full)
    return F.when(rest == "", full).otherwise(rest)


def subdivisions(plats: DataFrame, families: DataFrame, contexts: DataFrame, scored: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per family that is drawn; families with one label share what that label named."""
    p = drawn(plats.select("oid", "name", "recorded", "rings")).join(families, "oid")
    year = F.year("recorded")
    f = p.groupBy("family", F.col("family_label").alias("subdivision")).agg(
        F.collect_set("label").alias("labels"), F.min(year).alias("recorded_from"), F.max(year).alias("recorded_to"),
    )
    f = f.join(O.dissolved(staged(p.select("oid", "family", "rings"), "drawn"), "family"), "family", "left")
    keyed = F.array_sort(F.transform("labels", lambda x: F.struct(N.natural_key(x).alias("k"), x.alias("x"))))
    f = f.withColumn("phases", F.transform(keyed, lambda s: s["x"])).withColumn("phase_count", F.size("labels")).drop("labels")
    namer = contexts.filter("naming_plat is not null").select("place_id", F.col("naming_plat").alias("subdivision"))
    touched = scored.select("place_id", F.col("name").alias("subdivision")).distinct().join(namer, ["place_id", "subdivision"], "left_anti")
    told = namer.join(answers.select(F.col("place").alias("place_id"), "theme"), "place_id", "left").select("subdivision", F.col("place_id").alias("place"), F.coalesce("theme", F.lit("")).alias("theme"))
    for d in (listed(namer, ["subdivision"], contexts, "named"), listed(touched, ["subdivision"], contexts, "through"), themes(told)):
        f = f.join(d, "subdivision", "left")
    none = F.array().cast("array<string>")
    f = f.withColumns({"named": F.coalesce("named", none), "through": F.coalesce("through", none), "theme": F.coalesce("theme", F.lit(""))})
    return f.withColumn("has_streets", (F.size("named") > 0) | (F.size("through") > 0))


def phases(plats: DataFrame, families: DataFrame, contexts: DataFrame, crossing: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per (family, phase); crossing: place ids with a part inside each phase (``family``, ``phase_full``)."""
    p = drawn(plats.select("oid", "name", "recorded", "rings")).join(families, "oid")
    g = p.groupBy("family", F.col("family_label").alias("subdivision"), F.col("label").alias("phase_full")).agg(
        F.min(F.year("recorded")).alias("recorded"), F.array_sort(F.collect_list("name")).alias("plats"),
    )
    whole = O.dissolved(staged(p.select("oid", F.struct("family", "label").alias("act"), "rings"), "drawn"), "act")
    g = g.join(whole.select("act.family", F.col("act.label").alias("phase_full"), "rings"), ["family", "phase_full"], "left")
    namer = contexts.filter("naming_phase is not null").select("place_id", F.col("naming_plat").alias("subdivision"), F.col("naming_phase").alias("phase_full"))
    through = crossing.join(g.select("family", "subdivision", "phase_full"), ["family", "phase_full"]).join(namer, ["place_id", "subdivision", "phase_full"], "left_anti")
    g = g.join(listed(namer, ["subdivision", "phase_full"], contexts, "named"), ["subdivision", "phase_full"], "left")
    g = g.join(listed(through, ["family", "phase_full"], contexts, "through"), ["family", "phase_full"], "left")
    none = F.array().cast("array<string>")
    g = g.withColumns({"named": F.coalesce("named", none), "through": F.coalesce("through", none)})
    return g.withColumns({"phase": short_phase(F.col("phase_full"), F.col("subdivision")), "has_streets": (F.size("named") > 0) | (F.size("through") > 0)})


def parts_of(rings: Column) -> Column:
    """Polygons of their rings: a counter-clockwise ring is a hole of the one before."""
    none = F.array().cast("array<array<array<struct<x: double, y: double>>>>")

    def add(done: Column, ring: Column) -> Column:
        hole = (G.ring_area(ring) > 0) & (F.size(done) > 0)
        last = F.array_append(F.element_at(done, -1), ring)
        return F.when(hole, F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), last)).otherwise(F.array_append(done, F.array(ring)))

    return F.aggregate(rings, none, add)


def polygon(rings: Column) -> Column:
    """GeoJSON geometry of rings in metres, rounded; null without any."""
    spot = lambda p: G.to_lonlat(p["x"], p["y"])
    shown = lambda ring: without_repeats(rounded(F.transform(ring, spot)))
    clean = F.transform(parts_of(F.coalesce(rings, F.array().cast(f"array<{O.RING}>"))), lambda part: F.filter(F.transform(part, shown), lambda r: F.size(r) > 3))
    clean = F.filter(clean, lambda part: F.size(part) > 0)
    single = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get(clean, F.lit(0)).alias("coordinates")))
    many = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), clean.alias("coordinates")))
    return F.when(F.size(clean) == 0, F.lit(None).cast("string")).when(F.size(clean) == 1, single).otherwise(many)


def polygon_features(layer: DataFrame, key: str) -> DataFrame:
    """(place, feature): GeoJSON of each subdivision or phase that has an outline; ``key`` orders them."""
    props = F.to_json(F.struct(*[c for c in layer.columns if c != "rings"]), {"ignoreNullFields": "false"})
    d = layer.select(F.col(key).alias("place"), props.alias("p"), polygon(F.col("rings")).alias("g")).filter("g is not null")
    return d.select("place", F.concat(F.lit('{"type":"Feature","properties":'), "p", F.lit(',"geometry":'), "g", F.lit("}")).alias("feature"))
