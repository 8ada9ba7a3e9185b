"""Cohort retention: an embedded SQL engine works on hash buckets of clients, Spark adds up the cells.

Clicks and clients are dealt into buckets by a hash of the client.  A task writes its
bucket's rows to a database file of the embedded engine, batch by batch, and runs one
SQL statement there; the engine has a fixed memory limit and spills beside its file.
File and spill are the task's own and go with it: nothing else reads them, and a lost
task starts again from its shuffled rows.  A bucket's cells are additive, so Spark
sums them over all buckets.

A client with more than a thousandth of all clicks is hot; there are fewer than a
thousand of those.  A hot client's clicks are dealt over all buckets by a hash of the
row (equal rows still meet); its starts are found before by an aggregation with
map-side minima and travel with its rows.  For hot clients the buckets return sums for
each client and period, which are added up before the client is counted once.

Times are microseconds of the wall clock, so no session time zone takes part.

Defined results
* rows that are equal in all columns, extra ones included, count once; rows without
  ``ts`` or ``client_id`` are dropped; rows without ``arrived_at`` are known in state
  1 only; a null ``click_id`` is never late.
* a null, infinite or not-a-number ``value``, or one whose cents pass 64 bits, is 0 cents.
* a client that ``clients`` names several times has its smallest ``source`` that is not
  null; rows of ``clients`` without an id are ignored; extra columns there too.
* a client without an error event has no cells; empty tables give an empty result.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from platlark.functions.shared import staged

DAY = 86_400_000_000
WEEK = 7 * DAY
CELL = ["state", "segment", "cohort", "period"]


@dataclass(frozen=True)
class RetentionParams:
    """``start_kind`` opens a client's time; state 0 knows clicks that arrive before ``known_before``.

    bucket_rows: clicks in a bucket on average; memory_mb, threads: of the engine in each task.
    """

    start_kind: str = "error"
    known_before: datetime = datetime(2024, 2, 1)
    bucket_rows: int = 1_000_000
    hot_share: int = 1000
    memory_mb: int = 256
    threads: int = 1


SHARD_SQL = """
WITH clicks AS (
  SELECT DISTINCT client, crc, ts, early, opens, cents, row_a, row_b, hot, hot_start0, hot_start1 FROM rows WHERE is_click
), segments AS (
  SELECT client, min(segment) AS segment FROM rows WHERE NOT is_click GROUP BY client
), starts AS (
  SELECT client, crc, hot,
         CASE WHEN hot THEN any_value(hot_start0) ELSE min(ts) FILTER (opens AND early) END AS start0,
         CASE WHEN hot THEN any_value(hot_start1) ELSE min(ts) FILTER (opens) END AS start1
  FROM clicks GROUP BY client, crc, hot
), known AS (
  SELECT s.*, c.ts, c.cents, v.state, CASE v.state WHEN 0 THEN start0 ELSE start1 END AS start
  FROM clicks c JOIN starts s USING (client), (VALUES (0), (1)) v(state)
  WHERE v.state = 1 OR c.early
), visits AS (
  SELECT state, client, crc, hot, start0, start1, floor_div(start, {week}) AS cohort, (ts - start) // {week} AS period, sum(cents) AS cents
  FROM known WHERE ts >= start GROUP BY ALL
), flagged AS (
  SELECT v.*, coalesce(g.segment, '') AS segment,
         coalesce(floor_div(start0, {week}) <> floor_div(start1, {week}), false)::INT AS moved
  FROM visits v LEFT JOIN segments g USING (client)
)
SELECT state, segment, cohort, period, NULL::BIGINT AS client, count(*) AS users,
       sum(crc)::BIGINT AS users_crc32, sum(moved)::BIGINT AS moved, sum(cents)::DECIMAL(38, 0)::VARCHAR AS cents
FROM flagged WHERE NOT hot GROUP BY state, segment, cohort, period
UNION ALL
SELECT state, '', cohort, period, client, 1, crc, moved::BIGINT, cents::DECIMAL(38, 0)::VARCHAR FROM flagged WHERE hot
"""


def wall_micros(t: Column) -> Column:
    """Microseconds from 1970 to a wall-clock time."""
    t = t.cast("timestamp_ntz")
    day = F.unix_date(t.cast("date")).cast("long")
    seconds = F.hour(t) * 3600 + F.minute(t) * 60
    return day * F.lit(DAY) + seconds.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def _row_hashes(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of all columns; which of them are null takes part."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    nulls = F.concat(*[F.when(c.isNull(), F.lit("0")).otherwise(F.lit("1")) for c in cols])
    return [F.xxhash64(F.lit(seed), nulls, *cols) for seed in (1, 2)]


def _clicks(clicks: DataFrame, params: RetentionParams) -> DataFrame:
    """What the buckets need of each click with a time and a client."""
    a, b = _row_hashes(clicks)
    crc = F.crc32(F.col("click_id").cast("string").cast("binary"))
    late = F.when(crc % 3 == 0, crc % 100).otherwise(F.lit(0))
    value = F.col("value").cast("double")
    cents = F.floor(value * 100 + 0.5)
    whole = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < 9e16)
    before = int((params.known_before - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    return clicks.filter("ts is not null and client_id is not null").select(
        F.col("client_id").cast("long").alias("client"),
        F.crc32(F.col("client_id").cast("long").cast("string").cast("binary")).alias("crc"),
        wall_micros(F.col("ts")).alias("ts"),
        F.coalesce(wall_micros(F.col("arrived_at")) + F.coalesce(late, F.lit(0)) * F.lit(DAY) < before, F.lit(False)).alias("early"),
        F.coalesce(F.col("kind") == params.start_kind, F.lit(False)).alias("opens"),
        F.when(whole, cents).otherwise(F.lit(0)).cast("long").alias("cents"),
        a.alias("row_a"),
        b.alias("row_b"),
    )


@contextmanager
def _engine(params: RetentionParams):
    """A database file of the task's own, which goes with the task together with what the engine spilled."""
    import duckdb

    folder = tempfile.mkdtemp(prefix="bucket-")
    con = None
    try:
        con = duckdb.connect(
            os.path.join(folder, "bucket.duckdb"),
            config={"memory_limit": f"{params.memory_mb}MB", "threads": params.threads, "temp_directory": os.path.join(folder, "spill"), "preserve_insertion_order": False},
        )
        yield con
    finally:
        if con is not None:
            con.close()
        shutil.rmtree(folder, ignore_errors=True)


BUCKET = {
    "is_click": "BOOLEAN", "client": "BIGINT", "crc": "BIGINT", "ts": "BIGINT", "early": "BOOLEAN", "opens": "BOOLEAN", "cents": "BIGINT", "row_a": "BIGINT", "row_b": "BIGINT",
    "hot": "BOOLEAN", "hot_start0": "BIGINT", "hot_start1": "BIGINT", "segment": "VARCHAR",
}
#: In place of a null in columns of whole numbers, which pandas would make floating otherwise.
NONE = -(2**63)


def _shards(params: RetentionParams):
    """The function that turns a bucket's rows into its cells."""

    def run(batches: Iterator):
        import pandas as pd

        with _engine(params) as con:
            con.execute("CREATE MACRO floor_div(a, b) AS (a - ((a % b) + b) % b) // b")
            con.execute(f"CREATE TABLE rows ({', '.join(f'{k} {v}' for k, v in BUCKET.items())})")
            taken = ", ".join(f"nullif({c}, {NONE})" if c.startswith("hot_s") else c for c in BUCKET)
            for b in batches:
                con.register("batch", b)
                con.execute(f"INSERT INTO rows SELECT {taken} FROM batch")
                con.unregister("batch")
            found = con.execute(SHARD_SQL.format(week=WEEK))
            names = [x[0] for x in found.description]
            while rows := found.fetchmany(5000):
                out = pd.DataFrame(rows, columns=names)
                out["client"] = out["client"].astype("Int64")
                yield out

    return run


SHARD = "state int, segment string, cohort long, period long, client long, users long, users_crc32 long, moved long, cents string"


def retention(clicks: DataFrame, clients: DataFrame, params: RetentionParams = RetentionParams()) -> DataFrame:
    """One row for each nonempty (state, segment, cohort, period)."""
    spark = clicks.sparkSession
    rows = _clicks(clicks, params)
    sizes = rows.groupBy("client").agg(F.count(F.lit(1)).alias("n"))
    sizes = staged(sizes, "clicksof")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = sizes.filter(F.col("n") * params.hot_share > total).select("client")  # fewer than hot_share rows
    starts = (
        rows.filter("opens").join(F.broadcast(hot), "client", "left_semi").groupBy("client")
        .agg(F.min(F.when(F.col("early"), F.col("ts"))).alias("hot_start0"), F.min("ts").alias("hot_start1"))
    )
    hot = staged(hot.join(starts, "client", "left"), "hotclients")

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // params.bucket_rows))
    of = lambda *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    marked = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "client", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    none = F.lit(NONE)
    left = marked.select(
        F.lit(True).alias("is_click"), "client", "crc", "ts", "early", "opens", "cents", "row_a", "row_b", "hot",
        F.coalesce("hot_start0", none).alias("hot_start0"), F.coalesce("hot_start1", none).alias("hot_start1"), F.lit(None).cast("string").alias("segment"),
        F.when(F.col("hot"), of("row_a")).otherwise(of("client")).alias("bucket"),
    )
    named = clients.filter("client_id is not null").select(F.col("client_id").cast("long").alias("client"), F.col("source").cast("string").alias("segment"))
    zero, no = F.lit(0).cast("long"), F.lit(False)
    right = named.select(
        no.alias("is_click"), "client", zero.alias("crc"), zero.alias("ts"), no.alias("early"), no.alias("opens"), zero.alias("cents"), zero.alias("row_a"), zero.alias("row_b"),
        no.alias("hot"), none.alias("hot_start0"), none.alias("hot_start1"), "segment", of("client").alias("bucket"),
    )
    dealt = left.unionByName(right).repartitionById(n, "bucket").select(*BUCKET)
    cells = staged(dealt.mapInPandas(_shards(params), SHARD), "cells").withColumn("cents", F.col("cents").cast("decimal(38,0)"))

    own = named.join(F.broadcast(hot.select("client")), "client", "left_semi").groupBy("client").agg(F.min("segment").alias("own"))
    by_client = (
        cells.filter("client is not null")
        .groupBy("client", "state", "cohort", "period")
        .agg(F.sum("cents").alias("cents"), F.max("moved").alias("moved"), F.max("users_crc32").alias("users_crc32"))
        .join(F.broadcast(own), "client", "left")
        .select(
            "state", F.coalesce("own", F.lit("")).alias("segment"), "cohort", "period", F.lit(1).cast("long").alias("users"),
            "users_crc32", "moved", "cents",
        )
    )
    sums = ["users", "users_crc32", "moved", "cents"]
    both = cells.filter("client is null").select(*CELL, *sums).unionByName(by_client)
    return both.groupBy(*CELL).agg(*[F.sum(c).cast("long").alias(c) for c in sums])
