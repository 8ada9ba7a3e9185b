"""Results as a stream: answer tables are parsed as result files arrive, and searches resume where they stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from platlark.operators import answers as A
from platlark.operators.candidates import to_search


def result_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Result lines of the files that arrive in ``folder``."""
    return spark.readStream.schema(A.RESULT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def parse_into(results: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends the parsed rows of every micro-batch; batch_no lets later rows win."""

    def one(batch: DataFrame, number: int) -> None:
        rows = A.table_rows(A.texts(batch)).withColumn("batch_no", F.lit(number))
        rows.write.mode("overwrite").parquet(f"{path}/batch_no={number}")  # a repeated micro-batch replaces its own rows

    return results.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending_cores(cores: DataFrame, cache: DataFrame, limit: int | None = None) -> DataFrame:
    """What a resumed search still has to ask, in order."""
    out = to_search(cores, cache).orderBy("core")
    return out.limit(limit) if limit else out
