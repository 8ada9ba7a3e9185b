"""Sinks: stage tables, JSON lines, CSV files and map documents, through Spark's file commit."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from platlark.sources import documents


def table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A stage table as Parquet."""
    df.write.mode(mode).parquet(path)


def json_lines(df: DataFrame, path: str, line: str = "line", order: str | None = None, mode: str = "errorifexists") -> None:
    """One JSON text a line, in the order of a column."""
    d = df if order is None else df.orderBy(order)
    d.select(line).write.mode(mode).text(path)


def csv(df: DataFrame, path: str, order: list[str], mode: str = "errorifexists") -> None:
    df.orderBy(*order).write.mode(mode).csv(path, header=True, escape='"', emptyValue="", nullValue="")


def feature_lines(features: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A map layer as one GeoJSON feature a line, which grows with the cluster."""
    features.select("feature").write.mode(mode).text(path)


def feature_document(features: DataFrame, path: str, counts: DataFrame | None = None, mode: str = "errorifexists") -> None:
    """A map layer as one GeoJSON document, for a region that a browser can load.

    Features are sorted over the cluster and written in parallel; the commit joins the
    parts.  The bytes do not depend on the number of tasks.
    """
    head = '{"type":"FeatureCollection",'
    if counts is not None:
        by = counts.groupBy("field").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("value", F.lit("")), "n")))).alias("c"))
        rows = by.select("field", F.to_json("c").alias("c")).collect()  # one row a field
        head += '"counts":{' + ",".join(f"{json.dumps(r.field)}:{r.c}" for r in sorted(rows)) + "},"
    documents.save(features.orderBy("place", "feature").select("feature"), path, head + '"features":[', "]}", mode)


def json_map(rows: DataFrame, path: str, key: str, value: str | None = None, mode: str = "errorifexists") -> None:
    """One JSON object of the rows by their key, in its order; ``value``: one column to hold, else all others."""
    name = F.expr(f"substring(to_json(struct(`{key}` as k)), 6, length(to_json(struct(`{key}` as k))) - 6)")
    held = F.col(value) if value else F.struct(*[c for c in rows.columns if c != key])
    texts = rows.orderBy(key).select(F.concat(name, F.lit(":"), F.to_json(held, {"ignoreNullFields": "false"})).alias("text"))
    documents.save(texts, path, "{", "}", mode)


def append_run(record: DataFrame, path: str) -> None:
    record.write.mode("append").parquet(path)
