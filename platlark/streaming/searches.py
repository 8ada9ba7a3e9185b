"""A search service asked term by term: paced, resumable, and not stopped by a bad term.

Terms are saved as files of ``per_batch`` terms; a streaming query takes one file a
micro-batch, so its checkpoint knows which are done and each one's hits are saved before
the next begins.  A run that was killed goes on with the micro-batch that was open.  All
tasks share one pace: each pauses for the number of tasks times ``pause``, and the first
request of a task waits for its turn.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from platlark.sources.paged import fetch

HITS = "array<struct<qid: string, label: string, description: string, matched: string, match_type: string>>"
ANSWER = "struct<search: array<struct<id: string, label: string, description: string, match: struct<text: string, type: string>>>>"


@dataclass(frozen=True)
class SearchParams:
    pause: float = 0.25
    tasks: int = 1
    per_batch: int = 200
    tries: int = 4
    retry_pause: float = 1.0
    limit: int = 5
    language: str = "en"


def save_terms(cores: DataFrame, folder: str, params: SearchParams = SearchParams()) -> None:
    """Distinct cores in order, in files of at most ``per_batch``."""
    d = cores.select("core").filter("core is not null").distinct()
    d.repartitionByRange("core").sortWithinPartitions("core").write.option("maxRecordsPerFile", params.per_batch).text(folder)


def asked(terms: DataFrame, endpoint: str, params: SearchParams = SearchParams()) -> DataFrame:
    """(core, body, error): the answer to each term, or why there is none."""
    form = {"action": "wbsearchentities", "language": params.language, "uselang": params.language, "type": "item", "limit": str(params.limit), "format": "json"}

    def run(batches):
        from pyspark import TaskContext

        time.sleep(params.pause * (TaskContext.get().partitionId() % params.tasks))
        for b in batches:
            for core in b.column(0).to_pylist():
                body = error = None
                try:
                    body = fetch([endpoint], {**form, "search": core}, params.tries, params.retry_pause).decode()
                    json.loads(body)
                except (OSError, ValueError) as e:
                    body, error = None, str(e)[:200] or type(e).__name__
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (core, body, error)], ["core", "body", "error"])
                time.sleep(params.pause * params.tasks)

    return terms.select("core").repartition(params.tasks).mapInArrow(run, "core string, body string, error string")


def hits(answers: DataFrame) -> DataFrame:
    """(core, hits): parsed answers; a core without hits has an empty list."""
    text = lambda c: F.coalesce(c, F.lit(""))
    found = F.coalesce(F.from_json("body", ANSWER)["search"], F.from_json(F.lit("[]"), "array<struct<id: string, label: string, description: string, match: struct<text: string, type: string>>>"))
    one = lambda h: F.named_struct(
        F.lit("qid"), h["id"], F.lit("label"), text(h["label"]), F.lit("description"), text(h["description"]), F.lit("matched"), text(h["match"]["text"]), F.lit("match_type"), text(h["match"]["type"])
    )
    return answers.filter("error is null").select("core", F.transform(found, one).cast(HITS).alias("hits"))


def start(spark: SparkSession, terms: str, endpoint: str, out: str, checkpoint: str, params: SearchParams = SearchParams(), after: Callable[[int], None] | None = None):
    """Starts the query; hits and failed terms of micro-batch k go to ``out``/hits and ``out``/failed, each replaced if k is repeated.

    after: called with the number of every finished micro-batch.
    """

    def one(batch: DataFrame, number: int) -> None:
        answers = asked(batch, endpoint, params).persist()  # asked once for both tables
        try:
            hits(answers).write.mode("overwrite").parquet(f"{out}/hits/batch_no={number}")
            answers.filter("error is not null").select("core", "error").write.mode("overwrite").parquet(f"{out}/failed/batch_no={number}")
        finally:
            answers.unpersist()
        if after:
            after(number)

    read = spark.readStream.schema("core string").option("maxFilesPerTrigger", 1).text(terms)
    return read.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def found(spark: SparkSession, out: str) -> DataFrame:
    """core, pos, qid, label, description, matched, match_type of everything found so far."""
    d = spark.read.parquet(f"{out}/hits").select("core", F.posexplode("hits").alias("pos", "h"))
    return d.select("core", "pos", "h.*")


def searched(spark: SparkSession, out: str) -> DataFrame:
    """Cores that need no further search, with or without hits."""
    return spark.read.parquet(f"{out}/hits").select("core")
