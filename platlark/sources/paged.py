"""Paged HTTP services as Spark tables: ids first, then batches of ids, each a partition of its own.

A request is tried again with growing pauses after a server error, a refusal for
haste or a lost connection, first at the same endpoint and then at the next.  A batch is
one task, so a lost executor repeats that batch only.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from platlark.functions import geometry as G

RETRIED = {429, 500, 502, 503, 504}


def fetch(endpoints: list[str], form: dict[str, str], tries: int = 4, pause: float = 1.0, timeout: float = 60.0) -> bytes:
    """The body of a POST to the first endpoint that answers."""
    last: Exception | None = None
    for url in endpoints:
        for k in range(tries):
            try:
                with urllib.request.urlopen(url, urllib.parse.urlencode(form).encode(), timeout=timeout) as answer:
                    return answer.read()
            except urllib.error.HTTPError as e:
                if e.code not in RETRIED:
                    raise
                last = e
            except OSError as e:
                last = e
            if k + 1 < tries:
                time.sleep(pause * 2**k)
    raise ConnectionError(f"no endpoint answered: {last}")


class Batch(InputPartition):
    def __init__(self, values: list[str]):
        self.values = values


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.endpoints = options["endpoints"].split(",")
        self.form = json.loads(options.get("form", "{}"))
        self.field, self.values = options.get("field", "ids"), json.loads(options["values"])
        self.size = int(options.get("batch", "200"))
        self.tries, self.pause = int(options.get("tries", "4")), float(options.get("pause", "1"))
        self.joiner, self.template = options.get("joiner", ","), options.get("template", "{}")

    def partitions(self) -> list[Batch]:
        return [Batch(self.values[i : i + self.size]) for i in range(0, len(self.values), self.size)] or [Batch([])]

    def read(self, partition: Batch) -> Iterator[tuple]:
        if partition.values:
            asked = self.template.replace("{}", self.joiner.join(partition.values), 1)
            body = fetch(self.endpoints, {**self.form, self.field: asked}, self.tries, self.pause)
            yield (",".join(partition.values), body.decode())


class Paged(DataSource):
    """One row for each batch: its values and the body of the answer."""

    @classmethod
    def name(cls) -> str:
        return "paged_http"

    def schema(self) -> str:
        return "asked string, body string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def pages(spark: SparkSession, endpoints: list[str], values: list[str], field: str = "ids", form: dict | None = None, **options) -> DataFrame:
    """(asked, body) of every batch of ``values``; batches are fetched in parallel tasks.

    options: batch (values in a request), joiner, template (a text whose first {} takes
    the joined values), tries, pause.
    """
    spark.dataSource.register(Paged)
    named = {"endpoints": ",".join(endpoints), "field": field, "values": json.dumps(values), "form": json.dumps(form or {})}
    return spark.read.format("paged_http").options(**named, **{k: str(v) for k, v in options.items()}).load()


def street_extract(spark: SparkSession, endpoints: list[str], query: str, **options) -> DataFrame:
    """(body): the answer to one map query, with failover over the endpoints."""
    return pages(spark, endpoints, [query], "data", batch=1, **options).select("body")


class Failed(RuntimeError):
    """The service answered with an error of its own; it is not asked again."""


def _answer(endpoints: list[str], form: dict[str, str], tries: int, pause: float) -> dict:
    got = json.loads(fetch(endpoints, form, tries, pause))
    if "error" in got:
        raise Failed(str(got["error"])[:300])
    return got


class Ids(InputPartition):
    def __init__(self, first: int, ids: list[int]):
        self.first, self.ids = first, ids


class RecorderReader(DataSourceReader):
    """Plats by object id: the ids are asked for first, those that the filters leave are dealt into batches."""

    def __init__(self, options: dict[str, str]):
        self.endpoints, self.size = options["endpoints"].split(","), int(options.get("batch", "200"))
        self.tries, self.pause = int(options.get("tries", "4")), float(options.get("pause", "1"))
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters):
        names = {EqualTo: "eq", In: "in", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le"}
        for f in filters:
            if type(f) in names and f.attribute == ("oid",):
                self.tests.append((names[type(f)], f.value))
            else:
                yield f

    def _wanted(self, i: int) -> bool:
        ways = {"eq": lambda v: i == v, "in": lambda v: i in v, "gt": lambda v: i > v, "ge": lambda v: i >= v, "lt": lambda v: i < v, "le": lambda v: i <= v}
        return all(ways[k](v) for k, v in self.tests)

    def partitions(self) -> list[Ids]:
        got = _answer(self.endpoints, {"where": "1=1", "returnIdsOnly": "true", "f": "json"}, self.tries, self.pause)
        ids = [(k, i) for k, i in enumerate(sorted(got.get("objectIds") or [])) if self._wanted(i)]
        return [Ids(k, ids[k : k + self.size]) for k in range(0, len(ids), self.size)] or [Ids(0, [])]

    def read(self, partition: Ids) -> Iterator[tuple]:
        if not partition.ids:
            return
        place = {i: k for k, i in partition.ids}
        form = {"objectIds": ",".join(str(i) for i in place), "outFields": "*", "outSR": "4326", "returnGeometry": "true", "f": "json"}
        for f in _answer(self.endpoints, form, self.tries, self.pause).get("features", []):
            a = f["attributes"]
            rings = [[(float(p[0]), float(p[1])) for p in r] for r in (f.get("geometry") or {}).get("rings", [])]
            yield a["OBJECTID"], place.get(a["OBJECTID"]), a.get("SubdivisionName"), a.get("RecordedDate"), a.get("InitialTaxYear"), rings


class RecordedPlats(DataSource):
    """Recorded plats as typed rows, longitudes and latitudes as the service gives them."""

    @classmethod
    def name(cls) -> str:
        return "recorded_plats"

    def schema(self) -> str:
        return "oid long, ord long, name string, recorded_ms long, tax_year int, lonlat array<array<struct<lon: double, lat: double>>>"

    def reader(self, schema) -> RecorderReader:
        return RecorderReader(self.options)


class StreetReader(DataSourceReader):
    """Ways of map queries: a query is a task, tried at one endpoint after the other."""

    def __init__(self, options: dict[str, str]):
        self.endpoints, self.queries = options["endpoints"].split(","), json.loads(options["queries"])
        self.tries, self.pause = int(options.get("tries", "4")), float(options.get("pause", "1"))

    def partitions(self) -> list[Ids]:
        return [Ids(k, [k]) for k in range(len(self.queries))] or [Ids(0, [])]

    def read(self, partition: Ids) -> Iterator[tuple]:
        for k in partition.ids:
            got = json.loads(fetch(self.endpoints, {"data": self.queries[k]}, self.tries, self.pause))
            stamp = (got.get("osm3s") or {}).get("timestamp_osm_base")
            for at, e in enumerate(got.get("elements", [])):
                tags = e.get("tags") or {}
                points = [(float(p["lon"]), float(p["lat"])) for p in e.get("geometry") or []]
                yield k, at, e["id"], tags.get("name"), tags.get("highway"), e.get("nodes") or [], points, stamp


class MapWays(DataSource):
    """Ways as typed rows, with the number of their query and their place in its answer."""

    @classmethod
    def name(cls) -> str:
        return "map_ways"

    def schema(self) -> str:
        return "query int, pos int, way_id long, name string, highway string, nodes array<long>, lonlat array<struct<lon: double, lat: double>>, stamp string"

    def reader(self, schema) -> StreetReader:
        return StreetReader(self.options)


def recorded_plats(spark: SparkSession, endpoints: list[str], **options) -> DataFrame:
    """oid, ord, name, recorded_ms, tax_year, rings (metres); filters on ``oid`` decide which ids are asked for.

    options: batch, tries, pause.  Python sources take filters only where the session says so; it is told to.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedPlats)
    d = spark.read.format("recorded_plats").options(endpoints=",".join(endpoints), **{k: str(v) for k, v in options.items()}).load()
    rings = F.transform("lonlat", lambda r: F.transform(r, lambda p: G.to_utm(p["lon"], p["lat"])))
    return d.withColumn("rings", rings).drop("lonlat")


def map_ways(spark: SparkSession, endpoints: list[str], queries: list[str], **options) -> DataFrame:
    """way_id, ord, name, highway, nodes, lonlat, pts, stamp; a way that several queries answer comes once, from the first."""
    spark.dataSource.register(MapWays)
    d = spark.read.format("map_ways").options(endpoints=",".join(endpoints), queries=json.dumps(queries), **{k: str(v) for k, v in options.items()}).load()
    once = d.groupBy("way_id").agg(F.min_by(F.struct("name", "highway", "nodes", "lonlat", "stamp"), F.struct("query", "pos")).alias("w"), F.min(F.col("query").cast("long") * (1 << 32) + F.col("pos")).alias("ord"))
    d = once.select("way_id", "ord", "w.*")
    return d.withColumn("pts", F.transform("lonlat", lambda p: G.to_utm(p["lon"], p["lat"])))


def recorder_features(spark: SparkSession, endpoint: str, ids: list[int], form: dict | None = None, **options) -> DataFrame:
    """(asked, body): recorded polygons by batches of 200 object ids."""
    asked = {"outFields": "*", "outSR": "4326", "f": "json", **(form or {})}
    return pages(spark, [endpoint], [str(i) for i in ids], "objectIds", asked, **{"batch": 200, **options})


def claims(spark: SparkSession, endpoint: str, items: list[str], **options) -> DataFrame:
    """(item, type): classes of items, asked 400 at a time; type is null where there is none."""
    template = "SELECT ?item ?type WHERE { VALUES ?item { {} } OPTIONAL { ?item wdt:P31 ?type } }"
    bodies = pages(spark, [endpoint], [f"wd:{x}" for x in items], "query", **{"batch": 400, "joiner": " ", "template": template, **options})
    lines = F.slice(F.split(F.regexp_replace("body", "[\r\n]+$", ""), "\r?\n"), F.lit(2), F.lit(1 << 30))
    return bodies.select(F.explode(lines).alias("line")).select(F.from_csv("line", "item string, type string").alias("r")).select("r.*")


def searches(spark: SparkSession, endpoint: str, terms: list[str], limit: int = 5, **options) -> DataFrame:
    """(asked, body): one search a term, each a task of its own."""
    return pages(spark, [endpoint], terms, "search", {"limit": str(limit), "format": "json"}, **{"batch": 1, "pause": 0.25, **options})
