"""Answer tables of a batch run, parsed and resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from platlark.operators.candidates import lettered

# Answers that are no candidate letter, and the confidence bands on offer.
NO_CANDIDATE = ["NONE", "INVENTED", "PERSONAL"]
CONFIDENCES = ["high", "medium", "low"]

RESULT_SCHEMA = (
    "custom_id string, result struct<type: string, error: string, message: struct<content: array<struct<type: string, text: string>>, "
    "stop_reason: string, usage: struct<input_tokens: long, output_tokens: long, output_tokens_details: struct<thinking_tokens: long>>>>"
)


def texts(results: DataFrame) -> DataFrame:
    """(custom_id, text) of the requests that succeeded; only text blocks count."""
    blocks = F.filter(F.col("result.message.content"), lambda b: b["type"] == "text")
    return results.filter("result.type = 'succeeded'").select("custom_id", F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "\n").alias("text"))


def failures(results: DataFrame) -> DataFrame:
    """(custom_id, type, error) of the requests that did not succeed."""
    return results.filter("not (result.type <=> 'succeeded')").select("custom_id", F.col("result.type").alias("type"), F.substring(F.col("result.error"), 1, 200).alias("error"))


def table_rows(texts: DataFrame) -> DataFrame:
    """(custom_id, n, street, choice, confidence, theme, reasoning): valid rows; of a repeated n the last counts."""
    d = texts.select("custom_id", F.posexplode(F.split("text", "\\r\\n|\\r|\\n")).alias("line_no", "line")).filter(F.col("line").rlike("^\\s*\\|"))
    inner = F.regexp_replace(F.regexp_replace(F.trim("line"), "^\\|+", ""), "\\|+$", "")
    d = d.withColumn("c", F.transform(F.split(inner, "\\|"), lambda x: F.btrim(x, F.lit(" \t"))))
    cell = lambda k: F.coalesce(F.get("c", F.lit(k)), F.lit(""))
    d = d.withColumn("choice", F.upper(F.btrim(cell(2), F.lit("`* "))))
    valid = (F.size("c") >= 3) & cell(0).rlike("^[0-9]+$") & (F.col("choice").isin(NO_CANDIDATE) | F.col("choice").rlike("^[A-J]$"))
    d = d.filter(valid)
    row = F.struct(cell(1).alias("street"), "choice", F.lower(cell(3)).alias("confidence"), cell(4).alias("theme"), cell(5).alias("reasoning"))
    return d.groupBy("custom_id", F.try_to_number(cell(0), F.lit("9999999999")).cast("int").alias("n")).agg(F.max_by(row, "line_no").alias("r")).select("custom_id", "n", "r.*")


def resolve(index: DataFrame, rows: DataFrame, candidates: DataFrame, answered: DataFrame) -> DataFrame:
    """Every asked item of an answered request with its answer; ``status`` is answered or missing.

    A letter stands for the candidate that the prompt showed under it; one without a
    candidate is missing, not answered.
    """
    got = rows.select("custom_id", "n", "choice", "confidence", "theme", "reasoning")
    d = index.join(answered.select("custom_id").distinct(), "custom_id", "left_semi").join(got, ["custom_id", "n"], "left")
    d = d.withColumn("core", F.substring_index("place", "#", 1))
    by_letter = lettered(candidates).select("core", F.col("letter").alias("choice"), "qid", "label")
    d = d.join(by_letter, ["core", "choice"], "left")
    done = F.col("choice").isin(NO_CANDIDATE) | (F.coalesce("qid", F.lit("")) != "")
    blank = lambda c: F.when(F.col("choice").isin(NO_CANDIDATE), "").otherwise(F.coalesce(c, F.lit("")))
    return d.select(
        "place", "street", "n", "custom_id", "choice", blank("qid").alias("qid"), blank("label").alias("label"), "confidence", "theme", "reasoning",
        F.when(F.coalesce(done, F.lit(False)), "answered").otherwise("missing").alias("status"),
    )


def mix(resolved: DataFrame) -> DataFrame:
    """(kind, value, n): counts of answers and of confidences; bands not on offer are kept and marked."""
    a = resolved.filter("status = 'answered'")
    kinds = a.select(F.lit("answer").alias("kind"), F.when(F.col("choice").isin(NO_CANDIDATE), F.col("choice")).otherwise("letter").alias("value"))
    bands = a.select(F.when(F.col("confidence").isin(CONFIDENCES), "confidence").otherwise("off-menu confidence").alias("kind"), F.col("confidence").alias("value"))
    return kinds.union(bands).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def usage(results: DataFrame) -> DataFrame:
    """(input, output, thinking, truncated): tokens of the succeeded requests and how many were cut off."""
    u = F.col("result.message.usage")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return results.filter("result.type = 'succeeded'").agg(
        total(u["input_tokens"]).alias("input"), total(u["output_tokens"]).alias("output"),
        total(u["output_tokens_details"]["thinking_tokens"]).alias("thinking"),
        F.count_if(F.col("result.message.stop_reason") == "max_tokens").alias("truncated"),
    )


def latest(answers: DataFrame, order: str = "file_no") -> DataFrame:
    """One answer per place: that of the last file."""
    kept = [c for c in answers.columns if c not in ("place", order)]
    return answers.filter("place <> ''").groupBy("place").agg(F.max_by(F.struct(*kept), order).alias("a")).select("place", "a.*")


def at_least(confidence: Column, band: str) -> Column:
    """Whether a confidence is ``band`` or a stronger one."""
    return confidence.isin(CONFIDENCES[: CONFIDENCES.index(band) + 1])
