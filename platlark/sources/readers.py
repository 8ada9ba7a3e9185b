"""Scans of the input documents, each under a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from platlark.functions import geometry as G
from platlark.operators.answers import RESULT_SCHEMA

WAYS_SCHEMA = (
    "osm3s struct<timestamp_osm_base: string>, elements array<struct<type: string, id: long, nodes: array<long>, "
    "geometry: array<struct<lat: double, lon: double>>, tags: map<string, string>>>"
)
PLATS_SCHEMA = (
    "source string, fetched string, features array<struct<attributes: struct<OBJECTID: long, SubdivisionName: string, RecordedDate: long, "
    "InitialTaxYear: int>, geometry: struct<rings: array<array<array<double>>>>>>"
)
CANDIDATE_MAP = "map<string, array<struct<qid: string, label: string, description: string, matched: string, match_type: string>>>"
ANSWER_COLUMNS = ["place", "street", "n", "custom_id", "choice", "qid", "label", "confidence", "theme", "reasoning"]


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def ways(spark: SparkSession, path: str) -> DataFrame:
    """way_id, ord, name, highway, nodes, lonlat, pts of a street extract; ord is the position in the document."""
    e = _document(spark, path, WAYS_SCHEMA).select(F.posexplode("elements").alias("ord", "e"))
    lonlat = F.transform(F.coalesce("e.geometry", F.array().cast("array<struct<lat: double, lon: double>>")), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    tag = lambda k: F.try_element_at(F.col("e.tags"), F.lit(k))
    d = e.select(F.col("e.id").alias("way_id"), F.col("ord").cast("long"), tag("name").alias("name"), tag("highway").alias("highway"), F.coalesce("e.nodes", F.array().cast("array<long>")).alias("nodes"), lonlat.alias("lonlat"))
    return d.withColumn("pts", F.transform("lonlat", lambda p: G.to_utm(p["lon"], p["lat"])))


def extract_stamp(spark: SparkSession, path: str) -> str | None:
    """The extract's own timestamp, if it bears one."""
    row = _document(spark, path, WAYS_SCHEMA).select("osm3s.timestamp_osm_base").first()
    return row[0] if row else None


def plats(spark: SparkSession, path: str) -> DataFrame:
    """oid, ord, name, recorded_ms, tax_year, rings (metres) of a recorder's polygon document."""
    f = _document(spark, path, PLATS_SCHEMA).select(F.posexplode("features").alias("ord", "f"))
    rings = F.transform(
        F.coalesce("f.geometry.rings", F.array().cast("array<array<array<double>>>")),
        lambda r: F.transform(r, lambda p: G.to_utm(F.get(p, F.lit(0)), F.get(p, F.lit(1)))),
    )
    a = F.col("f.attributes")
    return f.select(a["OBJECTID"].alias("oid"), F.col("ord").cast("long"), a["SubdivisionName"].alias("name"), a["RecordedDate"].alias("recorded_ms"), a["InitialTaxYear"].alias("tax_year"), rings.alias("rings"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """core, pos, qid, label, description, matched, match_type of a candidate map; cores without hits give no rows."""
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", CANDIDATE_MAP)).alias("core", "hits"))
    return d.select("core", F.posexplode("hits").alias("pos", "h")).select("core", "pos", "h.*")


def searched_cores(spark: SparkSession, path: str) -> DataFrame:
    """Cores that a candidate map holds, with or without hits."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", CANDIDATE_MAP)).alias("core", "hits")).select("core")


def claims(spark: SparkSession, path: str) -> DataFrame:
    """item, type of a saved claim query."""
    return spark.read.csv(path, header=True, schema="item string, type string")


def results(spark: SparkSession, path: str) -> DataFrame:
    """Result lines of a batch; blank lines are skipped."""
    return spark.read.schema(RESULT_SCHEMA).json(path)


def batch_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="custom_id string, n int, place string, street string", multiLine=True, escape='"')


def answers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Answer files in the order given; ``file_no`` says which file a row is from."""
    out = None
    for k, path in enumerate(paths):
        one = spark.read.csv(path, header=True, schema=", ".join(f"{c} {'int' if c == 'n' else 'string'}" for c in ANSWER_COLUMNS), multiLine=True, escape='"')
        one = one.withColumn("file_no", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def place_ids(spark: SparkSession, path: str) -> DataFrame:
    """place_id of a JSON list of ids."""
    d = spark.read.text(path, wholetext=True)
    return d.select(F.explode(F.from_json("value", "array<string>")).alias("place_id"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """street, answer, note of the hand-made labels."""
    return spark.read.csv(path, header=True, schema="street string, answer string, note string", multiLine=True, escape='"')


RUN_SCHEMA = (
    "batch_id string, digest string, model string, requests int, items int, estimate_usd double, request_file string, index_file string, submitted string"
)


def run_records(spark: SparkSession, folder: str) -> DataFrame:
    """Run records of a folder; pointers and files that are no record are left out."""
    d = spark.read.schema(RUN_SCHEMA).json(f"{folder}/*.json", multiLine=True, mode="DROPMALFORMED")
    name = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    return d.filter(~name.isin("latest.json", "pending.json") & F.col("batch_id").isNotNull())
