"""Every operator as a query over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from platlark.functions import geometry as G, names as N, platnames as P
from platlark.functions.shared import dealt, staged
from platlark.operators import answers as A, candidates as C, chains as H, context as X, export as E, measure as M, overlay as O, places as L, plats as T, prompts as B, reports as Y, runs as R
from platlark.plans import stages, town

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


WAYS, PLATS, FACTS = (f"({town.sql(n)})" for n in ("ways", "plats", "facts"))
CANDIDATES, CLAIMS, ANSWERED, ANSWERS = (f"({town.sql(n)})" for n in ("candidates", "claims", "answered", "answers"))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_BARE = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"
PARTS_SQL = f"""
WITH t AS (SELECT way_id, ord, name, highway, string_split(trim(regexp_replace(name, '\\s+', ' ', 'g')), ' ') AS a FROM {WAYS} w),
d AS (SELECT *, len(a) > 1 AND list_contains({_list(N.DIRECTIONALS)}, {_BARE("a[1]")}) AS lead FROM t),
r AS (SELECT *, CASE WHEN lead THEN a[2:] ELSE a END AS rest, CASE WHEN lead THEN a[1] ELSE '' END AS direction FROM d),
s AS (SELECT *, len(rest) > 1 AND list_contains({_list(N.SUFFIXES)}, {_BARE("rest[-1]")}) AS trail FROM r),
parts AS (
  SELECT way_id, ord, name, highway, direction, array_to_string(CASE WHEN trail THEN rest[:-2] ELSE rest END, ' ') AS core,
         CASE WHEN trail THEN rest[-1] ELSE '' END AS post FROM s
), keyed AS (
  SELECT *, trim(regexp_replace(regexp_replace(lower(core), '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g')) AS key,
         CASE WHEN {_BARE("direction")} IN ('n', 'north', 's', 'south') THEN 'NS' WHEN {_BARE("direction")} IN ('e', 'east', 'w', 'west') THEN 'EW' ELSE '' END AS axis,
         CAST(CASE WHEN list_contains({_list(N.POST_RANK)}, {_BARE("post")}) THEN list_position({_list(N.POST_RANK)}, {_BARE("post")}) - 1 ELSE {len(N.POST_RANK)} END AS INT) AS post_rank
  FROM parts
)
"""


@query(PARTS_SQL + "SELECT way_id, direction, core, post, key, axis, post_rank FROM keyed")
def street_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = town.table(spark, sf_dir, "ways").select("way_id", N.parts(F.col("name")).alias("p"))
    return d.select(
        "way_id", "p.direction", "p.core", "p.post", N.spelled(F.col("p.core")).alias("key"), N.axis_of(F.col("p.direction")).alias("axis"), N.post_rank(F.col("p.post")).alias("post_rank")
    )


@query(PARTS_SQL + "SELECT key AS core, arg_min(name, ord) AS name FROM keyed WHERE highway <> 'trunk' AND key <> '' GROUP BY key")
def search_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.search_names(town.ways(spark, sf_dir))


@query(PARTS_SQL + "SELECT key AS core, count(*) AS ways, list_sort(list(DISTINCT highway)) AS classes, bool_and(highway IN ('residential', 'unclassified', 'tertiary', 'living_street')) AS analysed FROM keyed WHERE key <> '' GROUP BY key")
def ways_by_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = L.usable_ways(town.ways(spark, sf_dir))
    g = w.groupBy("core").agg(F.count(F.lit(1)).alias("ways"), F.array_sort(F.collect_set("highway")).alias("classes"))
    return g.withColumn("analysed", N.analysed(F.col("classes")))


@query(f"""
SELECT way_id, sqrt(dx * dx + dy * dy) + dx AS length_m, degrees(atan2(dy, dx)) AS first_bearing,
       CASE WHEN dy > 150 THEN NULL ELSE 'EW' END AS band_axis, y0 AS band_lo, y0 + dy AS band_hi
FROM {WAYS} w""")
def way_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("pts")
    d = town.ways(spark, sf_dir).withColumn("band", G.band(G.bbox(p)))
    return d.select(
        "way_id", G.length(p).alias("length_m"), G.bearing(F.get(p, F.lit(0)), F.get(p, F.lit(1))).alias("first_bearing"),
        F.col("band.axis").alias("band_axis"), F.col("band.lo").alias("band_lo"), F.col("band.hi").alias("band_hi"),
    )


@query(f"SELECT oid, -(x1 - x0) * (y1 - y0) AS area, false AS is_hole FROM {PLATS} p")
def ring_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = G.ring_area(F.col("ring"))
    return town.plats(spark, sf_dir).select("oid", F.explode("rings").alias("ring")).select("oid", area.alias("area"), (area > 0).alias("is_hole"))


def _outlined(d: DataFrame, key: str) -> DataFrame:
    """Shells, holes, area and perimeter of each row's rings."""
    areas = F.transform("rings", G.ring_area)
    sides = F.transform("rings", G.length)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    n = lambda f: F.size(F.filter(areas, f)).cast("long")
    return d.select(key, n(lambda a: a < 0).alias("shells"), n(lambda a: a > 0).alias("holes"), (-total(areas)).alias("area"), total(sides).alias("perimeter"))


@query(f"""
SELECT oid, CASE kind WHEN 4 THEN 2 ELSE 1 END AS shells, CASE WHEN kind IN (2, 4) THEN 1 ELSE 0 END AS holes,
       CASE kind WHEN 2 THEN w * h - 400 WHEN 4 THEN w * h - 3600 + 200 WHEN 5 THEN 2 * w * h - (w - 50) * (h - 30) ELSE w * h END AS area,
       2 * (w + h) + CASE kind WHEN 2 THEN 80 WHEN 4 THEN 300 WHEN 5 THEN 160 ELSE 0 END AS perimeter
FROM ({town.sql("odd")}) o""")
def repaired_plats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings that cross themselves, holes inside and outside, an island in a hole, shells that overlap."""
    p = staged(town.odd_plats(spark, sf_dir), "oddplats")
    return _outlined(O.repaired(p.withColumn("box", G.bbox(F.flatten("rings")))), "oid")


_BASE = "concat(split_part(name, ' ', 1), ' ', split_part(name, ' ', 2))"


@query(f"""
WITH p AS (SELECT {_BASE} AS base, x0, y0, x1, y1 FROM {PLATS} p),
xs AS (SELECT base, x AS a, lead(x) OVER (PARTITION BY base ORDER BY x) AS b, row_number() OVER (PARTITION BY base ORDER BY x) AS i FROM (SELECT base, x0 AS x FROM p UNION SELECT base, x1 FROM p)),
ys AS (SELECT base, y AS c, lead(y) OVER (PARTITION BY base ORDER BY y) AS d, row_number() OVER (PARTITION BY base ORDER BY y) AS j FROM (SELECT base, y0 AS y FROM p UNION SELECT base, y1 FROM p)),
full_cells AS (SELECT DISTINCT base, i, j, b - a AS w, d - c AS h FROM xs JOIN ys USING (base) JOIN p USING (base) WHERE x0 <= a AND b <= x1 AND y0 <= c AND d <= y1),
sides AS (
  SELECT f.base, f.w * f.h AS area,
         CASE WHEN l.i IS NULL THEN f.h ELSE 0 END + CASE WHEN r.i IS NULL THEN f.h ELSE 0 END + CASE WHEN u.i IS NULL THEN f.w ELSE 0 END + CASE WHEN o.i IS NULL THEN f.w ELSE 0 END AS edge
  FROM full_cells f LEFT JOIN full_cells l ON l.base = f.base AND l.i = f.i - 1 AND l.j = f.j LEFT JOIN full_cells r ON r.base = f.base AND r.i = f.i + 1 AND r.j = f.j
  LEFT JOIN full_cells u ON u.base = f.base AND u.i = f.i AND u.j = f.j - 1 LEFT JOIN full_cells o ON o.base = f.base AND o.i = f.i AND o.j = f.j + 1
)
SELECT base, sum(area) AS area, sum(edge) AS perimeter FROM sides GROUP BY base""")
def dissolved_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One outline around the rectangles of each naming act, which overlap, touch and lie apart."""
    p = T.recorded(town.plats(spark, sf_dir))
    return _outlined(O.dissolved(p.select("oid", "base", "rings"), "base"), "base").select("base", "area", "perimeter")


def _pieces(spark: SparkSession, sf_dir: str, step: float) -> DataFrame:
    """Pieces of 100 m a step apart, and branches of 100 m at their start."""
    d = town.table(spark, sf_dir, "pieces").distinct()
    x, off = F.col("n") * F.lit(step), F.col("off")
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return d.select("place_id", (F.lit(100.0) + F.col("n") % 7).alias("m"), at(x, F.lit(0)).alias("a"), at(x + 100 * (1 - off), 100 * off).alias("b"))


@query(f"""
WITH RECURSIVE p AS (SELECT place_id, n * 2 + off AS id, 100.0 + n % 7 AS m, n * 100.0::DOUBLE AS ax, 0.0::DOUBLE AS ay, (n + 1 - off) * 100.0::DOUBLE AS bx, off * 100.0::DOUBLE AS cy FROM (SELECT DISTINCT * FROM ({town.sql("pieces")}) q)),
ends AS (SELECT place_id, id, ax AS x, ay AS y FROM p UNION ALL SELECT place_id, id, bx, cy FROM p),
joints AS (SELECT place_id, x, y, min(id) AS u, max(id) AS v FROM ends GROUP BY ALL HAVING count(*) = 2),
e AS (SELECT place_id, u, v FROM joints UNION ALL SELECT place_id, v, u FROM joints),
reach AS (SELECT place_id, id AS u, id AS v FROM p UNION SELECT r.place_id, r.u, e.v FROM reach r JOIN e ON e.place_id = r.place_id AND e.u = r.v),
chain AS (SELECT place_id, u AS id, min(v) AS chain FROM reach GROUP BY place_id, u),
free AS (SELECT place_id, chain, min([x, y]) AS a, max([x, y]) AS b FROM ends JOIN chain USING (place_id, id) WHERE (place_id, x, y) NOT IN (SELECT (place_id, x, y) FROM joints) GROUP BY ALL),
whole AS (SELECT place_id, chain, sum(m) AS m FROM p JOIN chain USING (place_id, id) GROUP BY ALL)
SELECT place_id, m::DOUBLE AS m, a[1]::DOUBLE AS ax, a[2]::DOUBLE AS ay, b[1]::DOUBLE AS bx, b[2]::DOUBLE AS cy FROM whole JOIN free USING (place_id, chain)""")
def street_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbroken stretches: pieces joined where just two meet."""
    d = H.stretches(_pieces(spark, sf_dir, 100.0), ["place_id"])
    return d.select("place_id", "m", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("cy"))


@query(f"""
WITH p AS (SELECT place_id, n, off, 100.0 + n % 7 AS m FROM (SELECT DISTINCT * FROM ({town.sql("pieces")}) q)),
-- a piece's far end is 50 m before the next one's start; a branch's only near end is at its own start
spots AS (SELECT place_id, n, sum(m) AS m, bool_or(off = 0) AS ahead FROM p GROUP BY ALL),
runs AS (SELECT *, sum(CASE WHEN before IS NULL OR before < n - 1 OR NOT passed THEN 1 ELSE 0 END) OVER (PARTITION BY place_id ORDER BY n) AS run
         FROM (SELECT *, lag(n) OVER w AS before, lag(ahead) OVER w AS passed FROM spots WINDOW w AS (PARTITION BY place_id ORDER BY n))),
long AS (SELECT place_id, run, sum(m) AS m FROM runs GROUP BY ALL)
SELECT place_id, max(l.m)::DOUBLE AS run_m, (SELECT max(m) FROM p WHERE p.place_id = l.place_id)::DOUBLE AS longest_m FROM long l GROUP BY place_id""")
def longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of each street over gaps of up to 60 m, and its longest piece."""
    p = _pieces(spark, sf_dir, 150.0)
    key = ["place_id"]
    return H.longest_runs(p, key, 60.0).join(H.longest_runs(p, key, 0.0).withColumnRenamed("run_m", "longest_m"), key)


PLACES_SQL = (
    PARTS_SQL.strip()
    + f""", pts AS ({town.POINTS_SQL}),
w AS (SELECT k.way_id, k.ord, k.key AS core, k.axis, s.y0 AS lo, s.y0 + s.dy AS hi, sqrt(dx * dx + dy * dy) + dx AS m FROM keyed k JOIN {WAYS} s USING (way_id)),
e AS (
  SELECT DISTINCT a.way_id AS u, b.way_id AS v FROM w a JOIN w b ON a.core = b.core AND a.way_id <> b.way_id
  JOIN pts p ON p.way_id = a.way_id JOIN pts q ON q.way_id = b.way_id
  WHERE (a.lo - 150 <= b.hi AND b.lo - 150 <= a.hi) OR (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 4000000
), reach AS (SELECT way_id AS u, way_id AS v FROM w UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u),
comp AS (SELECT u AS way_id, min(v) AS comp FROM reach GROUP BY u),
c AS (SELECT w.*, comp FROM w JOIN comp USING (way_id)),
t AS (SELECT core, comp, min(ord) AS first, sum(m) FILTER (WHERE axis = 'NS') AS ns, sum(m) FILTER (WHERE axis = 'EW') AS ew FROM c GROUP BY core, comp),
h AS (SELECT c.*, first, CASE WHEN ns IS NULL OR ew IS NULL THEN '' WHEN axis <> '' THEN axis WHEN ew > ns THEN 'EW' ELSE 'NS' END AS half FROM c JOIN t USING (core, comp)),
members AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY core ORDER BY first, comp, half) - 1 AS INT) AS idx FROM h)
"""
).replace("WITH t AS", "WITH RECURSIVE t0 AS", 1).replace("FROM t)", "FROM t0)", 1)


@query(PLACES_SQL + "SELECT way_id, core, idx, core || '#' || idx AS place_id FROM members")
def place_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.place_ways(town.ways(spark, sf_dir))


@query(PLACES_SQL + """, top AS (SELECT core, idx, arg_max(direction, (run, -early)) AS direction, arg_max(words, (run, -early)) AS words FROM (SELECT members.core, members.idx, n.name, n.direction, n.core AS words, sum(m) AS run, min(members.ord) AS early FROM members JOIN keyed n USING (way_id) GROUP BY ALL) GROUP BY core, idx),
posts AS (SELECT core, idx, array_to_string(list(post ORDER BY rank), '/') AS posts FROM (SELECT DISTINCT members.core, members.idx, n.post, n.post_rank AS rank FROM members JOIN keyed n USING (way_id)) GROUP BY core, idx),
dirs AS (SELECT members.core, members.idx, count(DISTINCT n.direction) FILTER (WHERE n.direction <> '') AS d, sum(m) AS street_m, count(*) AS ways FROM members JOIN keyed n USING (way_id) GROUP BY ALL)
SELECT core || '#' || idx AS place_id, concat_ws(' ', CASE WHEN d = 1 AND direction <> '' THEN direction END, words, posts) AS name, street_m, ways
FROM top JOIN posts USING (core, idx) JOIN dirs USING (core, idx)""")
def place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = town.ways(spark, sf_dir)
    return L.describe(w, L.place_ways(w)).select("place_id", "name", "street_m", F.size("way_ids").cast("long").alias("ways"))


@query(PLACES_SQL + """SELECT core, count(DISTINCT idx) AS places, min(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))) AS separation
FROM (SELECT a.core, a.way_id AS u, b.way_id AS v, a.idx FROM members a JOIN members b ON a.core = b.core AND a.idx <> b.idx) JOIN pts p ON p.way_id = u JOIN pts q ON q.way_id = v GROUP BY core""")
def duplicate_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = town.ways(spark, sf_dir)
    return L.duplicates(w, L.place_ways(w))


@query(PLACES_SQL + f""", met AS (SELECT core || '#' || idx AS place_id, node_a AS node FROM members JOIN {WAYS} s USING (way_id) UNION SELECT core || '#' || idx, node_b FROM members JOIN {WAYS} s USING (way_id))
SELECT DISTINCT a.place_id, b.place_id AS other FROM met a JOIN met b ON a.node = b.node AND a.place_id <> b.place_id""")
def attached_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = town.ways(spark, sf_dir)
    return M.attached(L.place_ways(w), w)


def _lines(spark, sf_dir):
    w = town.ways(spark, sf_dir)
    return w.select("way_id", F.col("name").alias("place_id"), "pts")


@query(f"""SELECT w.way_id, p.oid FROM {WAYS} w JOIN {PLATS} p ON w.x0 <= p.x1 AND w.x0 + 2 * w.dx >= p.x0 AND w.y0 <= p.y1 AND w.y0 + w.dy >= p.y0""")
def plat_box_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.box_join(_lines(spark, sf_dir), T.recorded(town.plats(spark, sf_dir)))


@query(f"SELECT way_id, oid, sum(m * (t1 - t0)) AS inside_m FROM ({town.INSIDE_SQL}) WHERE t1 > t0 GROUP BY way_id, oid")
def metres_inside_plats(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = M.clip(_lines(spark, sf_dir), T.recorded(town.plats(spark, sf_dir)))
    return parts.groupBy("way_id", "oid").agg(F.sum(F.col("hi") - F.col("lo")).alias("inside_m"))


@query(f"""
WITH i AS (SELECT way_id, i, m, t0, t1 FROM ({town.INSIDE_SQL}) WHERE t1 > t0),
g AS (SELECT *, max(t1) OVER (PARTITION BY way_id, i ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM i)
SELECT w.name AS place_id, sum(g.m * greatest(0.0, t1 - greatest(t0, coalesce(seen, -1.0)))) AS covered_m FROM g JOIN {WAYS} w USING (way_id) GROUP BY w.name""")
def covered_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.covered(M.covered_parts(_lines(spark, sf_dir), T.recorded(town.plats(spark, sf_dir))))


@query(f"""
WITH pts AS ({town.POINTS_SQL}), v AS (SELECT w.name AS place_id, x, y, CAST(floor(x / 200) AS BIGINT) AS cx, CAST(floor(y / 200) AS BIGINT) AS cy FROM pts JOIN {WAYS} w USING (way_id)),
platted AS (SELECT DISTINCT w.name FROM ({town.INSIDE_SQL}) i JOIN {WAYS} w USING (way_id) WHERE t1 > t0),
bare AS (SELECT * FROM v WHERE place_id NOT IN (SELECT name FROM platted))
SELECT DISTINCT v.place_id, b.place_id AS other FROM v, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), bare b
WHERE b.cx = v.cx + i AND b.cy = v.cy + j AND b.place_id <> v.place_id AND (v.x - b.x) * (v.x - b.x) + (v.y - b.y) * (v.y - b.y) <= 40000""")
def near_unplatted_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, lines = town.ways(spark, sf_dir), _lines(spark, sf_dir)
    parts = M.clip(lines, T.recorded(town.plats(spark, sf_dir)))
    return M.near_unplatted(lines.select("way_id", "place_id"), w, parts)


@query(f"SELECT oid, name, base, [x FOR x IN string_split(levels, ',') IF x <> ''] AS levels, contains(name, ' AMD') AS amended, label FROM ({town.sql('filings')})")
def plat_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of every form, parsed and shown; the SQL has what each form stands for."""
    p = P.parse(town.table(spark, sf_dir, "filings").select("oid", "name"), "name").withColumn("base", P.base_of_parts())
    return P.display_name(p.select("oid", "name", "base", "levels", "amended"), "name", "label")


@query(f"""SELECT oid, CASE WHEN recorded_ms IS NULL THEN NULL ELSE CAST(epoch_ms(recorded_ms) AS DATE) END AS recorded, coalesce(year(epoch_ms(recorded_ms)), tax_year) AS plat_year,
  regexp_matches(name, '\\bAMD\\b') AS amended, substr(sha256(name), 1, 16) AS digest FROM {PLATS} p""")
def plat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = town.table(spark, sf_dir, "plats").withColumn("recorded", N.date_of_ms(F.col("recorded_ms")))
    return d.select("oid", "recorded", F.coalesce(F.year("recorded"), "tax_year").cast("long").alias("plat_year"), F.col("name").rlike(P.AMENDMENT).alias("amended"), N.digest(F.col("name")).alias("digest"))


FAMILIES_SQL = f"""
WITH p AS (
  SELECT oid, ord, regexp_replace(name, ' SUB NO.*', '') AS base, regexp_extract(name, 'NO 0([0-9])', 1) AS k, contains(name, 'AMD') AS amended,
         CASE WHEN recorded_ms IS NULL THEN NULL ELSE CAST(epoch_ms(recorded_ms) AS DATE) END AS recorded, floor(oid / 300.0) % 4 = 3 AS away FROM {PLATS} p
), f AS (
  SELECT *, base || CASE WHEN away THEN ' #2' ELSE '' END AS family, bool_or(away) OVER (PARTITION BY base) AS scattered,
         upper(base[1]) || lower(base[2:]) AS shown FROM p
), first AS (
  SELECT family, first(k ORDER BY amended, recorded IS NULL, recorded, ord) AS k FROM f GROUP BY family
), families AS (
  SELECT f.oid, f.family, CASE WHEN scattered THEN shown || ' #' || first.k ELSE shown END AS family_label,
         shown || CASE WHEN scattered THEN ' #' ELSE ', Phase ' END || f.k AS label, scattered FROM f JOIN first USING (family)
)
"""


@query(FAMILIES_SQL + "SELECT * FROM families")
def plat_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.families(T.recorded(town.plats(spark, sf_dir)))


@query(FAMILIES_SQL + "SELECT family_label, count(DISTINCT family) AS families FROM families GROUP BY family_label HAVING count(DISTINCT family) > 1")
def label_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.label_collisions(T.families(T.recorded(town.plats(spark, sf_dir))))


ENDS_SQL = (
    PARTS_SQL.strip()
    + f""", ends AS (
  SELECT k.key AS core, s.way_id, x0 AS x, y0 AS y, degrees(atan2(-dy, -dx)) AS b FROM keyed k JOIN {WAYS} s USING (way_id)
  UNION ALL SELECT k.key, s.way_id, x0 + 2 * dx, y0 + dy, 0.0 FROM keyed k JOIN {WAYS} s USING (way_id)
), folded AS (SELECT core, way_id, x, y, CASE WHEN b < 0 THEN b + 180 ELSE b END % 180 AS b FROM ends),
pairs AS (
  SELECT p.way_id AS src, q.way_id AS dst, sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) AS d, p.b AS ba, q.b AS bb,
         degrees(atan2(q.y - p.y, q.x - p.x)) AS t FROM folded p JOIN folded q ON p.core = q.core AND p.way_id < q.way_id
), gaps AS (
  SELECT src, dst, d, abs(ba - bb) % 180 AS g1, abs(ba - CASE WHEN t < 0 THEN t + 180 ELSE t END % 180) % 180 AS g2, abs(bb - CASE WHEN t < 0 THEN t + 180 ELSE t END % 180) % 180 AS g3 FROM pairs
)
SELECT DISTINCT src, dst FROM gaps WHERE d <= 2000 AND (d < 1 OR greatest(least(g1, 180 - g1), least(g2, 180 - g2), least(g3, 180 - g3)) <= 30)"""
)


@query(ENDS_SQL)
def alignment_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways of a core that touch or resume each other along one line."""
    return L.alignment_links(L.usable_ways(town.ways(spark, sf_dir)), L.PlaceParams())


@query(f"""SELECT w.name AS place_id, i.oid, sum(i.m * (t1 - t0)) / any_value(l.m) AS share FROM ({town.INSIDE_SQL}) i JOIN {WAYS} w USING (way_id)
JOIN (SELECT name, sum(sqrt(dx * dx + dy * dy) + dx) AS m FROM {WAYS} w GROUP BY name) l ON l.name = w.name WHERE t1 > t0 GROUP BY w.name, i.oid""")
def shares_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    places = lines.groupBy("place_id").agg(F.sum(G.length(F.col("pts"))).alias("street_m"))
    return M.share_inside(M.clip(lines, T.recorded(town.plats(spark, sf_dir))), places)


@query(f"SELECT DISTINCT p.tax_year AS phase, w.name AS place_id FROM ({town.INSIDE_SQL}) i JOIN {WAYS} w USING (way_id) JOIN {PLATS} p USING (oid) WHERE t1 > t0")
def crossing_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    plats = town.plats(spark, sf_dir)
    return M.crossing(T.recorded(plats).select("oid", F.col("tax_year").alias("phase"), "rings", "box"), _lines(spark, sf_dir))


@query(f"SELECT highway, count(*) AS ways, CAST(sum(3) AS BIGINT) AS points, CAST(sum(2) AS BIGINT) AS nodes FROM {WAYS} w GROUP BY highway")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.class_counts(town.ways(spark, sf_dir))


@query()
def street_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole decision chain: places, families, clipping, scores, naming, neighbours."""
    m = stages.measure(town.ways(spark, sf_dir), town.plats(spark, sf_dir))
    return stages.decide(m)[0].drop("plats")


SCORED_SQL = f"""
WITH f AS (SELECT place_id, core, base, name, CAST(make_date(year, 6, 1) AS DATE) AS recorded, year, sum(inside_m) AS inside_m, street_m, covered_m FROM {FACTS} f GROUP BY ALL),
s AS (
  SELECT place_id, core, base, name, recorded, year, street_m, covered_m, inside_m >= 0.4 * max(inside_m) OVER (PARTITION BY place_id) AS material,
         inside_m / street_m AS share0, inside_m / covered_m AS claim0, CAST(round_even(inside_m, 0) AS BIGINT) AS inside_m,
         CASE WHEN year IS NULL OR year <= 1915 THEN 0.15 WHEN year >= 1965 THEN 1.0 ELSE 0.15 + 0.85 * (year - 1915) / 50.0 END AS era_weight
  FROM f
), scored AS (SELECT *, round(share0, 3) AS share, round(claim0, 3) AS claim FROM s)
"""


def _scored(spark, sf_dir):
    f = town.table(spark, sf_dir, "facts").withColumn("recorded", F.make_date("year", F.lit(6), F.lit(1))).drop("year")
    f = dealt(f, "place_id")
    rows = f.groupBy("place_id", "base", "name", "recorded").agg(F.sum("inside_m").alias("inside_m"))
    rows = rows.withColumns({"run_m": F.col("inside_m"), "phase": F.col("name"), "phase_recorded": F.upper("name")})
    places = f.groupBy("place_id", "core").agg(F.max("street_m").alias("street_m"), F.max("covered_m").alias("covered_m"))
    return X.score(rows, places)


@query(SCORED_SQL + "SELECT place_id, base, inside_m, share, claim, material, era_weight FROM scored")
def plat_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("place_id", "base", "inside_m", "share", "claim", "material", "era_weight")


_PLAIN = lambda x: f"[w FOR w IN string_split(trim(regexp_replace(regexp_replace(lower({x}), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g')), ' ') IF NOT list_contains({_list(N.PLAT_TYPE_WORDS)}, w)]"
NAMING_SQL = (
    SCORED_SQL.strip()
    + f""", m AS (
  SELECT *, len({_PLAIN("core")}) > 0 AND {_PLAIN("core")} = {_PLAIN("name")} AS matched, material AND coalesce(year < 1950, false) AS old, material AND NOT coalesce(year < 1950, false) AS modern FROM scored
), g AS (
  SELECT *, bool_or(material AND share >= 0.15) OVER p AS may, bool_or(matched) OVER p AS any_match, max(inside_m) FILTER (WHERE old) OVER p AS best_old,
         max(inside_m) FILTER (WHERE modern) OVER p AS best_modern FROM m WINDOW p AS (PARTITION BY place_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY CASE WHEN any_match THEN 0 WHEN year IS NULL THEN 1 ELSE 0 END, CASE WHEN any_match THEN NULL ELSE recorded END, -inside_m, base) AS k
  FROM g WHERE may AND covered_m / street_m >= 0.25
    AND CASE WHEN any_match THEN matched WHEN best_modern IS NOT NULL AND (best_old IS NULL OR best_modern >= best_old) THEN modern ELSE material END
), naming AS (SELECT * FROM ranked WHERE k = 1)
"""
)


@query(NAMING_SQL + """SELECT place_id, base, share, claim, round(least(0.95, covered_m / street_m * claim), 3) AS confidence,
  round(least(0.95, covered_m / street_m * claim * era_weight), 3) AS theme_confidence, coalesce(year < 1950, false) AS naming_themeless_era FROM naming""")
def naming_plats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.confidences(X.naming_plats(_scored(spark, sf_dir)))
    return n.select("place_id", "base", "share", "claim", "confidence", "theme_confidence", "naming_themeless_era")


@query(NAMING_SQL + """SELECT n.place_id, count(*) FILTER (WHERE o.base = n.base) AS peers, count(*) FILTER (WHERE o.base IS DISTINCT FROM n.base) AS same_plat
FROM naming n JOIN (SELECT DISTINCT place_id, base FROM scored) t ON t.base = n.base AND t.place_id <> n.place_id LEFT JOIN naming o ON o.place_id = t.place_id GROUP BY n.place_id""")
def peer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    return X.peer_counts(scored, X.naming_plats(scored))


@query(NAMING_SQL + """, c AS (SELECT base, count(*) AS n FROM naming GROUP BY base), l AS (SELECT list(n ORDER BY n) AS v FROM c)
SELECT len(v) AS n, v[len(v) // 2 + 1] AS median, v[CAST(floor(len(v) * 0.9) AS INT) + 1] AS p90, v[-1] AS max FROM l""")
def naming_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.naming_plats(_scored(spark, sf_dir)).groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    d = Y.spread(n.select(F.lit("places").alias("line"), F.col("n").alias("v")))
    return d.select("n", *[F.col(c).cast("long").alias(c) for c in ("median", "p90", "max")])


_SIZES = {c: f"CAST(count(*) FILTER (WHERE l_linenumber % 4 = {k}) AS BIGINT)" for k, c in enumerate(Y.NEIGHBOURS)}
CONTEXT_SQL = f"""
WITH c AS (
  SELECT l_orderkey AS k, {", ".join(f"{e} AS {c}" for c, e in _SIZES.items())}, l_orderkey % 5 <> 0 AS analysed, CASE WHEN l_orderkey % 3 > 0 THEN 'PLAT' END AS naming_plat,
         CASE WHEN l_orderkey % 3 > 0 THEN round(l_orderkey % 997 / 997.0, 3)::DOUBLE END AS confidence, CAST(l_orderkey % 4 AS INT) AS contenders
  FROM lineitem GROUP BY l_orderkey
)"""


def _measured_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place for each order, its neighbours counted from the order's lines."""
    k = F.col("l_orderkey")
    named = k % 3 > 0
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(*[F.count_if(F.col("l_linenumber") % 4 == i).alias(c) for i, c in enumerate(Y.NEIGHBOURS)])
    return d.select(
        *Y.NEIGHBOURS, (k % 5 != 0).alias("analysed"), F.when(named, "PLAT").alias("naming_plat"),
        F.when(named, F.round(k % 997 / F.lit(997.0), 3)).alias("confidence"), (k % 4).cast("int").alias("contenders"),
    )


@query(CONTEXT_SQL + f""", v AS (
  {" UNION ALL ".join(f"SELECT '{c}' AS line, {c}::DOUBLE AS v FROM c WHERE analysed" for c in Y.NEIGHBOURS)}
  UNION ALL SELECT 'total', ({" + ".join(Y.NEIGHBOURS)})::DOUBLE FROM c WHERE analysed UNION ALL SELECT 'confidence', confidence FROM c WHERE analysed AND confidence IS NOT NULL
), l AS (SELECT line, list(v ORDER BY v) AS v FROM v GROUP BY line)
SELECT line, len(v) AS n, v[len(v) // 2 + 1] AS median, v[CAST(floor(len(v) * 0.9) AS INT) + 1] AS p90, v[-1] AS max FROM l""")
def context_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, 90th percentile and largest of every kind of neighbour and of the confidence."""
    return Y.context_spread(_measured_contexts(spark, sf_dir))


@query(CONTEXT_SQL + """, s AS (
  SELECT count(*)::DOUBLE AS n, count(naming_plat)::DOUBLE AS named, count(*) FILTER (WHERE contenders > 1)::DOUBLE AS open, count(confidence)::DOUBLE AS judged,
         count(*) FILTER (WHERE confidence < 0.5)::DOUBLE AS unsure FROM c WHERE analysed
) SELECT 'analysed' AS line, n AS value FROM s UNION ALL SELECT 'named', named FROM s UNION ALL SELECT 'named_share', named / n FROM s UNION ALL SELECT 'several_plats', open FROM s
UNION ALL SELECT 'several_plats_share', open / n FROM s UNION ALL SELECT 'under_half_share', unsure / judged FROM s""")
def context_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.context_figures(_measured_contexts(spark, sf_dir))


CLAIMS_SQL = f"SELECT replace(item, 'http://kb.example.org/entity/', '') AS qid, list_sort(list(DISTINCT replace(type, 'http://kb.example.org/entity/', '')) FILTER (WHERE type <> '')) AS types FROM {CLAIMS} c GROUP BY item"
KEPT_SQL = f"""
WITH claims AS ({CLAIMS_SQL}), j AS (SELECT c.*, coalesce(t.types, []) AS types FROM {CANDIDATES} c LEFT JOIN claims t USING (qid)),
kept AS (
  SELECT core, qid, label, description, CAST(row_number() OVER (PARTITION BY core ORDER BY pos) - 1 AS INT) AS pos FROM j
  WHERE NOT CASE WHEN len(types) > 0 THEN list_has_all({_list(C.EXCLUDE_TYPES)}, types)
                 ELSE description IN ('family', 'name', 'personal name') OR contains(description, 'family name') OR contains(description, 'given name') END
)
"""


@query(f"SELECT qid, coalesce(types, []) AS types FROM ({CLAIMS_SQL})")
def claim_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.claim_types(town.table(spark, sf_dir, "claims"))


def _kept(spark, sf_dir):
    return C.publishable(town.table(spark, sf_dir, "candidates"), C.claim_types(town.table(spark, sf_dir, "claims")))


@query(KEPT_SQL + "SELECT * FROM kept")
def publishable_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir).select("core", "qid", "label", "description", "pos")


@query(KEPT_SQL + f"SELECT DISTINCT core FROM {CANDIDATES} c WHERE core NOT IN (SELECT core FROM kept)")
def emptied_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.emptied(town.table(spark, sf_dir, "candidates"), _kept(spark, sf_dir))


@query(KEPT_SQL + "SELECT core, list('    - **' || substr('ABCDEFGHIJ', pos + 1, 1) || '.** ' || label || ' — ' || CASE WHEN description = '' THEN '(no description)' ELSE description END ORDER BY pos) AS lines FROM kept WHERE pos < 10 GROUP BY core")
def candidate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.lines(_kept(spark, sf_dir))


@query(f"SELECT DISTINCT concat('core', CAST(s_suppkey * 11 AS VARCHAR)) AS core FROM supplier WHERE concat('core', CAST(s_suppkey * 11 AS VARCHAR)) NOT IN (SELECT core FROM {CANDIDATES} c)")
def cores_to_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    cores = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("core"), (F.col("s_suppkey") * 11).cast("string")).alias("core")).distinct()
    return C.to_search(cores, town.table(spark, sf_dir, "candidates"))


ITEMS_SQL = KEPT_SQL.strip() + ", items AS (SELECT core || '#0' AS place, CAST(row_number() OVER (ORDER BY core || '#0') AS INT) AS n FROM (SELECT DISTINCT core FROM kept WHERE pos < 10)) "


def _contexts(spark, sf_dir):
    """A context record for every core with candidates, its neighbours the cores numbered next to it."""
    c = town.table(spark, sf_dir, "candidates").select("core").distinct()
    k = F.substring(F.col("core"), 5, 20).cast("int")
    near = lambda *ds: F.array(*[F.concat(F.lit("core"), k + d, F.lit("#0")) for d in ds])
    named = k % 3 > 0
    return c.select(
        F.concat("core", F.lit("#0")).alias("place_id"), "core", F.concat(F.lit("North Core "), k, F.lit(" Street")).alias("name"), F.concat(F.lit("Core "), k % 40).alias("display"),
        F.when(named, F.concat(F.lit("Plat "), k)).alias("naming_plat"), F.when(named, F.lit("1950-06-01")).alias("naming_recorded"),
        F.when(named, 0.5).alias("confidence"), F.when(named, 0.25).alias("theme_confidence"),
        near(1, 2).alias("peers"), near(2, 40).alias("same_plat"), near(3).alias("attached"), near(1, 3, 4).alias("near_unplatted"),
    )


@query(f"""
WITH c AS (SELECT DISTINCT core, CAST(substr(core, 5) AS INT) AS k FROM {CANDIDATES} c),
a AS (SELECT k, 1 AS tier, unnest([k + 1, k + 2]) AS o FROM c UNION ALL SELECT k, 2, unnest([k + 2, k + 40]) FROM c UNION ALL SELECT k, 3, unnest([k + 1, k + 3, k + 4]) FROM c),
s AS (SELECT a.k, 'Core ' || (a.o % 40) AS shown, min(tier) AS tier FROM a JOIN c ON c.k = a.o WHERE a.o % 40 <> a.k % 40 GROUP BY ALL)
SELECT concat('core', k, '#0') AS place_id, CAST(tier AS INT) AS tier, shown FROM s""")
def neighbour_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.tiers(_contexts(spark, sf_dir)).select("place_id", "tier", "shown")


def _items(spark, sf_dir):
    return B.numbered_items(_contexts(spark, sf_dir), C.lines(_kept(spark, sf_dir)))


@query(ITEMS_SQL + "SELECT printf('batch-%04d', (n - 1) // 40) AS custom_id, n, place, 'North Core ' || replace(replace(place, '#0', ''), 'core', '') || ' Street' AS street FROM items")
def batch_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.batch_index(_items(spark, sf_dir))


@query()
def batch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.requests(B.blocks(_items(spark, sf_dir), _contexts(spark, sf_dir)))


@query()
def batch_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.estimate(batch_requests(spark, sf_dir))


ROWS_SQL = f"""
WITH l AS (SELECT custom_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM {ANSWERED} a),
c AS (SELECT custom_id, k, [trim(x) FOR x IN string_split(trim(trim(line), '|'), '|')] AS c FROM l WHERE starts_with(trim(line), '|')),
v AS (SELECT custom_id, k, c, upper(trim(c[3], '`* ')) AS choice FROM c WHERE len(c) >= 3 AND regexp_full_match(c[1], '[0-9]+')),
rows AS (
  SELECT custom_id, CAST(c[1] AS INT) AS n, arg_max(c[2], k) AS street, arg_max(choice, k) AS choice, arg_max(lower(coalesce(c[4], '')), k) AS confidence,
         arg_max(coalesce(c[5], ''), k) AS theme, arg_max(coalesce(c[6], ''), k) AS reasoning
  FROM v WHERE choice IN ('NONE', 'INVENTED', 'PERSONAL') OR regexp_full_match(choice, '[A-J]') GROUP BY custom_id, CAST(c[1] AS INT)
)
"""


@query(ROWS_SQL + "SELECT * FROM rows")
def answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table_rows(town.table(spark, sf_dir, "answered"))


def _resolved(spark, sf_dir):
    texts = town.table(spark, sf_dir, "answered")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    index = customer.select(F.concat(F.lit("batch-"), "c_custkey").alias("custom_id"), F.col("c_custkey").cast("int").alias("n"), F.concat(F.lit("core"), F.col("c_custkey") % 500, F.lit("#0")).alias("place"), F.col("c_name").alias("street"))
    return A.resolve(index, A.table_rows(texts), _kept(spark, sf_dir), texts)


RESOLVED_SQL = (
    KEPT_SQL.strip()
    + ", "
    + ROWS_SQL.strip()[5:]
    + """, resolved AS (
  SELECT 'core' || (c_custkey % 500) || '#0' AS place, c_name AS street, CAST(c_custkey AS INT) AS n, r.choice, k.qid, r.confidence,
         CASE WHEN r.choice IN ('NONE', 'INVENTED', 'PERSONAL') OR coalesce(k.qid, '') <> '' THEN 'answered' ELSE 'missing' END AS status
  FROM customer LEFT JOIN rows r ON r.custom_id = 'batch-' || c_custkey AND r.n = c_custkey
  LEFT JOIN kept k ON k.core = 'core' || (c_custkey % 500) AND k.pos < 10 AND substr('ABCDEFGHIJ', k.pos + 1, 1) = r.choice
)
"""
)


@query(RESOLVED_SQL + "SELECT place, street, n, choice, CASE WHEN choice IN ('NONE', 'INVENTED', 'PERSONAL') THEN '' ELSE coalesce(qid, '') END AS qid, confidence, status FROM resolved")
def resolved_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("place", "street", "n", "choice", "qid", "confidence", "status")


@query(RESOLVED_SQL + """SELECT 'answer' AS kind, CASE WHEN choice IN ('NONE', 'INVENTED', 'PERSONAL') THEN choice ELSE 'letter' END AS value, count(*) AS n FROM resolved WHERE status = 'answered' GROUP BY ALL
UNION ALL SELECT CASE WHEN confidence IN ('high', 'medium', 'low') THEN 'confidence' ELSE 'off-menu confidence' END, confidence, count(*) FROM resolved WHERE status = 'answered' GROUP BY ALL""")
def answer_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mix(_resolved(spark, sf_dir))


LATEST_SQL = f"WITH latest AS (SELECT place, arg_max(choice, file_no) AS choice, arg_max(qid, file_no) AS qid, arg_max(confidence, file_no) AS confidence, arg_max(theme, file_no) AS theme FROM {ANSWERS} a GROUP BY place) "


def _latest(spark, sf_dir):
    return A.latest(town.table(spark, sf_dir, "answers"))


@query(LATEST_SQL + "SELECT place, choice, qid, confidence, theme, CASE WHEN qid <> '' THEN 'ENTITY' ELSE choice END AS category FROM latest WHERE confidence IN ('high', 'medium')")
def latest_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _latest(spark, sf_dir).filter(A.at_least(F.col("confidence"), "medium"))
    return a.select("place", "choice", "qid", "confidence", "theme", E.category(F.lit(True), F.col("qid"), F.col("choice")).alias("category"))


def _streets(spark, sf_dir):
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    places = supplier.select(F.concat(F.lit("place"), k, F.lit("#0")).alias("place_id"), F.concat(F.lit("core"), k % 50).alias("core"), F.col("s_name").alias("name"))
    # suppliers of region 2's nations have no line: they are places without geometry
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"))
    drawn = supplier.join(F.broadcast(nations), "s_nationkey", "left_anti")
    lines = drawn.select(F.concat(F.lit("place"), k, F.lit("#0")).alias("place_id"), F.array(E.rounded(F.array(F.struct((k / 7).alias("lon"), (k / 3).alias("lat"))))).alias("coordinates"))
    contexts = supplier.select(
        F.concat(F.lit("place"), k, F.lit("#0")).alias("place_id"), F.when(k % 4 > 0, F.concat(F.lit("Phase "), k)).alias("naming_phase"), F.when(k % 4 > 0, F.concat(F.lit("Plat "), k)).alias("naming_plat"),
        F.when(k % 4 > 0, F.concat(F.lit("PLAT "), k)).alias("naming_phase_recorded"), F.when(k % 5 > 0, F.concat(1900 + k * 7 % 120, F.lit("-01-01"))).alias("naming_recorded"),
    )
    candidates = _kept(spark, sf_dir)
    answers = _latest(spark, sf_dir).withColumns({"label": F.col("qid"), "reasoning": F.lit("")})
    return E.streets(places, lines, answers, candidates, contexts)


STREETS_SQL = KEPT_SQL.strip() + ", " + LATEST_SQL.strip()[5:] + """, streets AS (
  SELECT 'place' || s_suppkey || '#0' AS place, s_name AS street, 'core' || (s_suppkey % 50) AS core, CAST(count(*) OVER (PARTITION BY s_suppkey % 50) AS INT) AS places_with_core, s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AS drawn,
         coalesce(l.qid, '') AS qid, coalesce(l.theme, '') AS theme, CASE WHEN l.place IS NULL THEN 'not_asked' ELSE 'answered' END AS status,
         CASE WHEN l.place IS NOT NULL THEN '' WHEN 'core' || (s_suppkey % 50) IN (SELECT core FROM kept) THEN 'not_in_a_run_yet' ELSE 'no_wikidata_candidate' END AS not_asked_because,
         CASE WHEN s_suppkey % 4 > 0 THEN 'Phase ' || s_suppkey ELSE '' END AS subdivision, CAST(CASE WHEN s_suppkey % 5 > 0 THEN 1900 + s_suppkey * 7 % 120 END AS INT) AS plat_year,
         CASE WHEN l.place IS NULL THEN 'NOT_ASKED' WHEN l.qid <> '' THEN 'ENTITY' ELSE l.choice END AS category
  FROM supplier LEFT JOIN latest l ON l.place = 'place' || s_suppkey || '#0'
), shown AS (
  SELECT *, CASE WHEN plat_year IS NULL THEN '' WHEN plat_year < 1940 THEN 'pre-1940' WHEN plat_year < 1970 THEN '1940-1969' WHEN plat_year < 1990 THEN '1970-1989' WHEN plat_year < 2010 THEN '1990-2009' ELSE '2010-' END AS plat_era FROM streets WHERE drawn
) """


@query(STREETS_SQL + "SELECT place, street, core, places_with_core, qid, theme, status, not_asked_because, subdivision, plat_year, plat_era, category FROM shown")
def street_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streets(spark, sf_dir).select("place", "street", "core", "places_with_core", "qid", "theme", "status", "not_asked_because", "subdivision", "plat_year", "plat_era", "category")


@query(STREETS_SQL + """, a AS (SELECT DISTINCT place FROM latest), s AS (
  SELECT (SELECT count(*) FROM a)::DOUBLE AS answers, count(*)::DOUBLE AS n, count(*) FILTER (WHERE status = 'answered')::DOUBLE AS answered, (SELECT count(*) FROM a WHERE place NOT IN (SELECT place FROM shown))::DOUBLE AS lost,
         count(*) FILTER (WHERE subdivision <> '')::DOUBLE AS named, count(*) FILTER (WHERE category NOT IN ('ENTITY', 'INVENTED', 'PERSONAL'))::DOUBLE AS odd FROM shown
) SELECT 'answers' AS line, answers AS value FROM s UNION ALL SELECT 'features', n FROM s UNION ALL SELECT 'answered', answered FROM s UNION ALL SELECT 'not_asked', n - answered FROM s
UNION ALL SELECT 'answered_without_shape', lost FROM s UNION ALL SELECT 'with_subdivision', named FROM s UNION ALL SELECT 'without_subdivision', n - named FROM s UNION ALL SELECT 'unknown_category', odd FROM s""")
def layer_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a drawn layer holds: answered and unasked streets, answers without a shape, categories beyond three known ones."""
    return Y.layer_figures(_streets(spark, sf_dir), _latest(spark, sf_dir), ["ENTITY", "INVENTED", "PERSONAL"])


@query(KEPT_SQL.strip() + f""", s AS (SELECT (SELECT count(DISTINCT core) FROM {CANDIDATES} c)::DOUBLE AS cores, (SELECT count(*) FROM {CANDIDATES} c)::DOUBLE AS n, count(DISTINCT core)::DOUBLE AS cores_left, count(*)::DOUBLE AS n_left FROM kept)
SELECT 'cores' AS line, cores AS value FROM s UNION ALL SELECT 'cores_left', cores_left FROM s UNION ALL SELECT 'candidates', n FROM s UNION ALL SELECT 'left', n_left FROM s
UNION ALL SELECT 'dropped', n - n_left FROM s UNION ALL SELECT 'dropped_share', (n - n_left) / n FROM s""")
def candidate_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.candidate_figures(town.table(spark, sf_dir, "candidates"), _kept(spark, sf_dir))


@query(STREETS_SQL + "SELECT 'category' AS field, category AS value, count(*) AS n FROM shown GROUP BY ALL UNION ALL SELECT 'plat_era', plat_era, count(*) FROM shown GROUP BY ALL")
def street_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.legend(_streets(spark, sf_dir))


@query()
def street_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.street_features(_streets(spark, sf_dir))


@query(f"""SELECT theme, list_sort(list_distinct([CASE WHEN regexp_matches(w, '^.{{3,}}ies$') THEN w[:-4] WHEN regexp_matches(w, '^.{{3,}}ing$') THEN w[:-4] WHEN regexp_matches(w, '^.{{3,}}ary$') THEN w[:-4]
  WHEN regexp_matches(w, '^.{{3,}}es$') THEN w[:-3] WHEN regexp_matches(w, '^.{{3,}}s$') THEN w[:-2] ELSE w END FOR w IN string_split(regexp_replace(lower(theme), '[^a-z ]', ' ', 'g'), ' ') IF len(w) > 2 AND NOT list_contains({_list(N.THEME_STOP)}, w)])) AS words,
  lower(trim(theme)) NOT IN ('', 'none', 'unclear', 'no theme', 'n/a', 'unknown') AS themed, count(*) AS n FROM {ANSWERS} a GROUP BY theme""")
def theme_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = town.table(spark, sf_dir, "answers").groupBy("theme").agg(F.count(F.lit(1)).alias("n"))
    return t.select("theme", F.array_sort(N.theme_words(F.col("theme"))).alias("words"), N.themed(F.col("theme")).alias("themed"), "n")


@query("""
WITH named AS (SELECT concat('Plat ', CAST(s_nationkey AS VARCHAR)) AS subdivision, s_name AS place, CASE WHEN s_nationkey % 3 = 0 THEN 'tree names' WHEN s_suppkey % 2 = 0 THEN 'birds' ELSE 'tree species' END AS theme FROM supplier),
n AS (SELECT subdivision, count(*) AS n, count(*) FILTER (WHERE theme = 'birds') AS birds, count(*) FILTER (WHERE theme <> 'birds') AS trees,
             arg_min(theme, place) FILTER (WHERE theme <> 'birds') AS tree FROM named GROUP BY subdivision)
SELECT subdivision, CASE WHEN n < 5 OR least(birds, trees) >= 3 THEN '' WHEN trees > birds THEN tree ELSE 'birds' END AS theme FROM n""")
def subdivision_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups of themes: trees under one name in each plat, and birds."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    theme = F.when(n % 3 == 0, "tree names").when(k % 2 == 0, "birds").otherwise("tree species")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return E.themes(s.select(F.concat(F.lit("Plat "), n.cast("string")).alias("subdivision"), F.col("s_name").alias("place"), theme.alias("theme")))


@query(f"""SELECT name, CAST(row_number() OVER (ORDER BY [CASE WHEN regexp_full_match(t, '[0-9]+') THEN lpad(t, 18, '0') ELSE t END FOR t IN regexp_extract_all(lower(name), '([0-9]+|[^0-9]+)', 1)], name) AS INT) AS rank
FROM (SELECT DISTINCT name FROM {PLATS} p)""")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = town.table(spark, sf_dir, "plats").select("name").distinct().withColumn("k", F.struct(N.natural_key(F.col("name")).alias("k"), "name"))
    return B.number(d, "k", "rank").select("name", "rank")


@query("SELECT CAST(user_id AS BIGINT) AS batch_id FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90)")
def orphan_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("batch_id"), "event_type", "value")
    return R.orphans(e.select("batch_id").distinct(), e.filter("event_type = 'purchase' and value > 90"))


@query("SELECT arg_min(event_id, (ts, event_id)) AS batch_id, min(ts) AS submitted, 'view' AS digest FROM events WHERE event_type = 'view'")
def sent_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return R.sent_before(e.select(F.col("event_id").alias("batch_id"), F.col("ts").alias("submitted"), F.col("event_type").alias("digest")), "view")


@query("SELECT arg_max(event_id, (ts, event_id)) AS batch_id, max(ts) AS submitted FROM events")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return R.latest_run(e.select(F.col("event_id").alias("batch_id"), F.col("ts").alias("submitted")))


@query("SELECT CAST(sum(length(c_name)) AS BIGINT) AS input, CAST(sum(c_custkey) AS BIGINT) AS output, CAST(sum(c_nationkey) AS BIGINT) AS thinking, count(*) FILTER (WHERE c_custkey % 7 = 0) AS truncated FROM customer WHERE c_custkey % 5 <> 0")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey")
    u = F.struct(F.length("c_name").cast("long").alias("input_tokens"), k.alias("output_tokens"), F.struct(F.col("c_nationkey").cast("long").alias("thinking_tokens")).alias("output_tokens_details"))
    m = F.struct(F.when(k % 7 == 0, "max_tokens").otherwise("end_turn").alias("stop_reason"), u.alias("usage"))
    return A.usage(c.select(F.struct(F.when(k % 5 == 0, "errored").otherwise("succeeded").alias("type"), m.alias("message")).alias("result")))
