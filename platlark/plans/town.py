"""A made-up town derived from the driver's tables, so that every operator can be run on them.

Each column is one expression in the SQL that Spark and DuckDB share; the queries
build DataFrames from it and the oracle the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

WORDS = "Alder,Birch,Cedar,Dogwood,Elm,Fir,Ginkgo,Hazel,Ironwood,Juniper,Katsura,Larch"
POSTS = "Street,Avenue,Drive,Court,Way,Lane,Road"
KINDS = "tree genus,family name,,given name,river in Asia,species of bird"
THEMES = "trees,tree names,none,birds,Unclear,bird species,weak gem theme"

WAYS = {
    "way_id": "o_orderkey",
    "ord": "o_orderkey",
    "name": f"concat(split_part(',North ,East ,South ,West ', ',', CAST(o_orderkey % 5 + 1 AS INT)), split_part('{WORDS}', ',', CAST(o_custkey % 12 + 1 AS INT)), ' ', CAST(o_custkey AS VARCHAR(20)), ' ', split_part('{POSTS}', ',', CAST(o_orderkey % 7 + 1 AS INT)))",
    "highway": "split_part('residential,tertiary,trunk,living_street,unclassified', ',', CAST(o_custkey % 5 + 1 AS INT))",
    "x0": "CAST((o_custkey % 97) * 4000 + (o_orderkey % 7) * 600 AS DOUBLE)",
    "y0": "CAST((o_custkey % 89) * 4000 + (o_orderkey % 11) * 350 AS DOUBLE)",
    "dx": "CAST(100 + o_orderkey % 13 * 20 AS DOUBLE)",
    "dy": "CAST(o_orderkey % 3 * 40 AS DOUBLE)",
    "node_a": "CAST(floor(o_orderkey / 4.0) AS BIGINT)",
    "node_b": "CAST(1000000000 + o_custkey % 997 AS BIGINT)",
}

PLATS = {
    "oid": "p_partkey",
    "ord": "p_partkey",
    "name": f"concat(upper(split_part('{WORDS}', ',', CAST(p_partkey % 12 + 1 AS INT))), ' ', CAST(p_partkey % 300 + 100 AS VARCHAR(20)), ' SUB NO 0', CAST(p_partkey % 3 + 1 AS VARCHAR(20)), CASE WHEN p_partkey % 13 = 0 THEN ' AMD' ELSE '' END)",
    "recorded_ms": "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_partkey % 300 AS BIGINT) * 9000000000 - 1400000000000 END",
    "tax_year": "CAST(1900 + p_partkey % 120 AS INT)",
    "x0": "CAST(((p_partkey % 300) % 97) * 4000 + floor(p_partkey / 300.0) * 350 + CASE WHEN floor(p_partkey / 300.0) % 4 = 3 THEN 60000 ELSE 0 END AS DOUBLE)",
    "y0": "CAST(((p_partkey % 300) % 89) * 4000 + p_partkey % 5 * 100 AS DOUBLE)",
    "x1": "CAST(((p_partkey % 300) % 97) * 4000 + floor(p_partkey / 300.0) * 350 + CASE WHEN floor(p_partkey / 300.0) % 4 = 3 THEN 60000 ELSE 0 END + 400 + p_partkey % 5 * 300 AS DOUBLE)",
    "y1": "CAST(((p_partkey % 300) % 89) * 4000 + p_partkey % 5 * 100 + 600 + p_partkey % 4 * 500 AS DOUBLE)",
}

_WORD = f"split_part('{WORDS}', ',', CAST(p_partkey % 12 + 1 AS INT))"
#: Recorded names of six forms, with the naming act, levels and label that each has by its form.
_FORMS = [
    ("{W} 3{k} SUB NO 0{k}", "{W} 3{k}", "{k}", "{w} 3{k}, Phase {k}"),
    ("{W} HEIGHTS 0{k}ND ADD TO RIVERTON", "{W} HEIGHTS 0{k}ND", "", "{w} Heights, {k}nd Addition to Riverton"),
    ("{W} ESTATES THE SUB UNIT NO 0{k} BLOCK 4", "THE {W} ESTATES BLOCK 4", "{k}", "The {w} Estates, Phase {k} Block 4"),
    ("A B {W} ACRES PHASE 0{k}A AMD", "A B {W} ACRES", "{k},A", "A. B. {w} Acres, Phase {k}.A"),
    ("MC{W} CONDO PROJ AREA {k}", "MC{W} CONDO", "", "Mc{w} Condo Area {k}"),
    ("LITTLE {W} II OF THE PARK SUB", "LITTLE {W} II OF THE PARK", "", "Little {w} II of the Park"),
]


def _form(i: int) -> str:
    """One column of the forms as SQL over ``part``."""

    def one(text: str) -> str:
        text = "'" + text + "'"
        for mark, value in (("{W}", f"upper({_WORD})"), ("{w}", _WORD), ("{k}", "CAST(p_partkey % 8 + 2 AS VARCHAR(20))")):
            text = text.replace(mark, f"', {value}, '")
        return f"concat({text})"

    return "CASE CAST(p_partkey % 6 AS INT) " + " ".join(f"WHEN {k} THEN {one(f[i])}" for k, f in enumerate(_FORMS)) + " END"


FILINGS = {"oid": "p_partkey", "name": _form(0), "base": _form(1), "levels": _form(2), "label": _form(3)}

#: Facts for the naming rules: one row per (place, plat).
FACTS = {
    "place_id": "concat('core', CAST(l_orderkey AS VARCHAR(20)), '#0')",
    "core": f"concat(lower(split_part('{WORDS}', ',', CAST(l_orderkey % 12 + 1 AS INT))), ' hill')",
    "base": "concat('PLAT ', CAST(l_suppkey AS VARCHAR(20)))",
    "name": f"concat(split_part('{WORDS}', ',', CAST(l_suppkey % 12 + 1 AS INT)), CASE WHEN l_suppkey % 2 = 0 THEN ' Hill Estates' ELSE ' Grove' END)",
    "inside_m": "l_quantity * 10.0 + l_linenumber + 0.25",
    "year": "CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE CAST(1900 + l_suppkey * 7 % 120 AS INT) END",
    "street_m": "CAST(400 + l_orderkey % 17 * 100 AS DOUBLE) + 1.7319",
    "covered_m": "CAST(100 + l_orderkey % 13 * 90 AS DOUBLE) + 0.4147",
}

CANDIDATES = {
    "core": "concat('core', CAST(c_custkey % 500 AS VARCHAR(20)))",
    "pos": "CAST(floor(c_custkey / 500.0) AS INT)",
    "qid": "concat('Q', CAST(c_custkey AS VARCHAR(20)))",
    "label": "c_name",
    "description": f"split_part('{KINDS}', ',', CAST(c_custkey % 6 + 1 AS INT))",
}

CLAIMS = {
    "item": "concat('http://kb.example.org/entity/Q', CAST(c_custkey AS VARCHAR(20)))",
    "type": "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('http://kb.example.org/entity/', split_part('Q101352,Q202444,Q1093580,Q5', ',', CAST(c_nationkey % 4 + 1 AS INT))) END",
}

ANSWERED = {
    "custom_id": "concat('batch-', CAST(c_custkey AS VARCHAR(20)))",
    "text": "concat('Some prose | with a bar', chr(10), '| n | street | choice | confidence | theme | reasoning |', chr(10), '|---|---|---|---|---|---|', chr(10), '| ', CAST(c_custkey AS VARCHAR(20)), ' | ', c_name, ' | ', split_part('`A`,b,NONE,**Invented**,Z,PERSONAL,K,C', ',', CAST(c_custkey % 8 + 1 AS INT)), ' | ', split_part('High,low,medium,certain', ',', CAST(c_nationkey % 4 + 1 AS INT)), ' | trees |', chr(10), '| 7 | x | NONE | low | |', chr(10), '| 7 | y | INVENTED |')",
}

ANSWERS = {
    "place": "concat('place', CAST(user_id % 200 AS VARCHAR(20)), '#0')",
    "file_no": "event_id",
    "choice": "split_part('A,NONE,INVENTED,PERSONAL,B', ',', CAST(event_id % 5 + 1 AS INT))",
    "qid": "CASE WHEN event_id % 5 IN (0, 4) THEN concat('Q', CAST(event_id AS VARCHAR(20))) ELSE '' END",
    "confidence": "split_part('high,medium,low,certain', ',', CAST(event_id % 4 + 1 AS INT))",
    "theme": f"split_part('{THEMES}', ',', CAST(event_id % 7 + 1 AS INT))",
}

#: Pieces of streets in plats: some of a row of places each, and short ones that branch off.
PIECES = {"place_id": "concat('street', CAST(l_suppkey AS VARCHAR(20)))", "n": "l_orderkey % 997", "off": "CASE WHEN l_linenumber = 1 AND l_orderkey % 997 % 5 = 0 THEN 1 ELSE 0 END"}

#: Plats whose rings need a second look, by kind: plain, a figure-eight, with a hole, with a hole outside, with an island in a hole, of two shells that overlap.
ODD = {
    "oid": "p_partkey",
    "kind": "CAST(p_partkey % 6 AS INT)",
    "x": "CAST(p_partkey % 1000 * 1000 AS DOUBLE)",
    "y": "CAST(floor(p_partkey / 1000.0) * 1000 AS DOUBLE)",
    "w": "CAST(100 + p_partkey % 7 * 10 AS DOUBLE)",
    "h": "CAST(80 + p_partkey % 5 * 10 AS DOUBLE)",
}

SOURCES = {
    "pieces": ("lineitem", PIECES), "odd": ("part", ODD), "ways": ("orders", WAYS), "plats": ("part", PLATS), "filings": ("part", FILINGS), "facts": ("lineitem", FACTS), "candidates": ("customer", CANDIDATES),
    "claims": ("customer", CLAIMS), "answered": ("customer", ANSWERED), "answers": ("events", ANSWERS),
}


def sql(name: str) -> str:
    """The derived table as SQL over the driver's tables."""
    source, columns = SOURCES[name]
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {source}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table as a DataFrame."""
    source, columns = SOURCES[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def _point(x, y):
    return F.struct(x.alias("x"), y.alias("y"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways with their points: three corners each."""
    w = table(spark, sf_dir, "ways")
    x, y, dx, dy = (F.col(c) for c in ("x0", "y0", "dx", "dy"))
    pts = F.array(_point(x, y), _point(x + dx, y + dy), _point(x + 2 * dx, y + dy))
    return w.select("way_id", "ord", "name", "highway", F.array("node_a", "node_b").alias("nodes"), pts.alias("pts"))


def plats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plats: one clockwise rectangle each."""
    p = table(spark, sf_dir, "plats")
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    ring = F.array(_point(x0, y0), _point(x0, y1), _point(x1, y1), _point(x1, y0), _point(x0, y0))
    return p.select("oid", "ord", "name", "recorded_ms", "tax_year", F.array(ring).alias("rings"))


def _box(x, y, w, h):
    """A clockwise rectangle."""
    return F.array(_point(x, y), _point(x, y + h), _point(x + w, y + h), _point(x + w, y), _point(x, y))


def odd_plats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plats with rings of every kind of ``ODD``."""
    x, y, w, h = (F.col(c) for c in "xywh")
    hole = lambda *a: F.reverse(_box(*a))
    n = lambda v: F.lit(float(v))
    eight = F.array(_point(x, y), _point(x, y + h), _point(x + w, y + h), _point(x + w, y - h), _point(x + 2 * w, y - h), _point(x + 2 * w, y), _point(x, y))
    rings = [
        F.array(_box(x, y, w, h)),
        F.array(eight),
        F.array(_box(x, y, w, h), hole(x + 10, y + 10, n(20), n(20))),
        F.array(_box(x, y, w, h), hole(x + 10, y + 400, n(20), n(20))),
        F.array(_box(x, y, w, h), hole(x + 10, y + 10, n(60), n(60)), _box(x + 15, y + 12, n(20), n(10))),
        F.array(_box(x, y, w, h), _box(x + 50, y + 30, w, h)),
    ]
    made = F.lit(None)
    for k, r in enumerate(rings):
        made = F.when(F.col("kind") == k, r).otherwise(made)
    return table(spark, sf_dir, "odd").select("oid", "kind", made.alias("rings"))


#: Corners of the ways and their segments, as SQL common to both engines.
POINTS_SQL = f"""
SELECT way_id, 1 AS i, x0 AS x, y0 AS y FROM ({sql("ways")}) w
UNION ALL SELECT way_id, 2, x0 + dx, y0 + dy FROM ({sql("ways")}) w
UNION ALL SELECT way_id, 3, x0 + 2 * dx, y0 + dy FROM ({sql("ways")}) w
"""
SEGMENTS_SQL = f"""
SELECT way_id, 1 AS i, x0 AS ax, y0 AS ay, x0 + dx AS bx, y0 + dy AS cy FROM ({sql("ways")}) w
UNION ALL SELECT way_id, 2, x0 + dx, y0 + dy, x0 + 2 * dx, y0 + dy FROM ({sql("ways")}) w
"""
#: Share of each segment inside each rectangle: the overlap of the two slabs along it.
INSIDE_SQL = f"""
SELECT s.way_id, p.oid, s.i, sqrt((bx - ax) * (bx - ax) + (cy - ay) * (cy - ay)) AS m,
       greatest(0.0, (p.x0 - ax) / (bx - ax), CASE WHEN cy = ay THEN 0.0 ELSE (p.y0 - ay) / nullif(cy - ay, 0) END) AS t0,
       least(1.0, (p.x1 - ax) / (bx - ax), CASE WHEN cy = ay THEN 1.0 ELSE (p.y1 - ay) / nullif(cy - ay, 0) END) AS t1
FROM ({SEGMENTS_SQL}) s JOIN ({sql("plats")}) p
  ON ax <= p.x1 AND bx >= p.x0 AND ay <= p.y1 AND cy >= p.y0 AND (cy > ay OR (ay >= p.y0 AND ay <= p.y1))
"""
