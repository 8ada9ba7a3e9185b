"""Command line: measure, decide, ask, read and draw over saved files, each stage in a session of its own."""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from platlark.functions import names as N
from platlark.operators import answers as A, candidates as C, export as E, prompts as B, reports as Y
from platlark.plans import stages
from platlark.sources import readers, writers


def _candidates(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    found = readers.candidates(spark, a.candidates)
    return C.publishable(found, C.claim_types(readers.claims(spark, a.claims))) if a.claims else found


def measure(spark: SparkSession, a: argparse.Namespace) -> None:
    stages.save(stages.measure(readers.ways(spark, a.ways), readers.plats(spark, a.plats)), a.out)


def context(spark: SparkSession, a: argparse.Namespace) -> None:
    contexts, scored = stages.decide(stages.load(spark, a.measures))
    if a.dump:
        print("\n".join(r.text for r in Y.dump(contexts, N.key(F.lit(a.dump))).collect()))
        return
    writers.table(scored, f"{a.out}/scored")
    writers.table(contexts, f"{a.out}/contexts")
    saved = spark.read.parquet(f"{a.out}/contexts")
    writers.json_map(saved, f"{a.out}/contexts.json", "place_id")
    counted = Y.neighbour_counts(saved)
    Y.context_spread(counted).orderBy("line").show()
    Y.context_figures(counted).show(100, False)


def filter_(spark: SparkSession, a: argparse.Namespace) -> None:
    """The candidates that are left, as a map like the one that was read, and how many were dropped."""
    found = readers.candidates(spark, a.candidates)
    kept = C.publishable(found, C.claim_types(readers.claims(spark, a.claims)))
    fields = [c for c in found.columns if c not in ("core", "pos")]
    hits = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("h")))), lambda x: x["h"])
    writers.json_map(kept.groupBy("core").agg(hits.alias("hits")), a.out, "core", "hits")
    Y.candidate_figures(found, kept).show(100, False)


def batch(spark: SparkSession, a: argparse.Namespace) -> None:
    contexts = spark.read.parquet(f"{a.context}/contexts")
    only = readers.place_ids(spark, a.only) if a.only else None
    exclude = None
    if a.exclude:
        asked = [readers.batch_index(spark, x).select(F.col("place").alias("place_id")) for x in a.exclude]
        exclude = reduce(DataFrame.unionByName, asked).distinct()
    requests, index, estimate = stages.ask(contexts, _candidates(spark, a), only=only, exclude=exclude, limit=a.limit, sample=a.sample)
    writers.json_lines(requests, f"{a.out}/requests", order="custom_id")
    writers.csv(index, f"{a.out}/index", ["n"])
    estimate.show()


def answers(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = stages.read(readers.results(spark, a.results), readers.batch_index(spark, a.index), _candidates(spark, a))
    done = rows.filter("status = 'answered'").select(*readers.ANSWER_COLUMNS)
    writers.csv(done, a.out, ["n"])
    A.mix(rows).orderBy("kind", F.desc("n")).show(100, False)


def draw(spark: SparkSession, a: argparse.Namespace) -> None:
    m = stages.load(spark, a.measures)
    contexts, scored = (spark.read.parquet(f"{a.context}/{t}") for t in ("contexts", "scored"))
    given = A.latest(readers.answers(spark, a.answers))
    streets, subdivisions, phases = stages.draw(m, contexts, scored, given, _candidates(spark, a))
    writers.feature_document(E.street_features(streets), f"{a.out}/streets", E.legend(streets))
    writers.feature_document(E.polygon_features(subdivisions, "family"), f"{a.out}/subdivisions")
    writers.feature_document(E.polygon_features(phases.withColumn("key", F.concat_ws(" / ", "family", "phase_full")), "key"), f"{a.out}/phases")
    E.legend(streets).orderBy("field", "value").show(100, False)
    Y.layer_figures(streets, given, E.CATEGORIES).show(100, False)


def estimate(spark: SparkSession, a: argparse.Namespace) -> None:
    lines = spark.read.text(a.requests)
    asked = lines.select(F.get_json_object("value", "$.params.messages[0].content").alias("prompt"))
    B.estimate(asked.withColumn("items", F.size(F.split("prompt", "\n### ")) - 1)).show()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="platlark")
    sub = p.add_subparsers(dest="stage", required=True)
    known = ("--candidates", "--claims")

    def add(f, *options: str, **extra) -> argparse.ArgumentParser:
        q = sub.add_parser(f.__name__.rstrip("_"))
        for o in options:
            q.add_argument(o, nargs="+" if o == "--exclude" else None, required=o not in ("--claims", "--only", "--exclude", "--dump", "--out"))
        q.set_defaults(run=f, **extra)
        return q

    add(measure, "--ways", "--plats", "--out")
    add(context, "--measures", "--out", "--dump")
    q = add(batch, "--context", *known, "--only", "--exclude", "--out")
    for o in ("--limit", "--sample"):
        q.add_argument(o, type=int)
    add(answers, "--results", "--index", *known, "--out")
    add(draw, "--measures", "--context", *known, "--out").add_argument("--answers", nargs="+", required=True)
    add(estimate, "--requests")
    add(filter_, "--candidates", "--out").add_argument("--claims", required=True)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    if getattr(a, "out", "x") is None and not getattr(a, "dump", None):
        parser().error("--out is needed")
    a.run(spark or SparkSession.builder.appName(f"platlark-{a.stage}").getOrCreate(), a)


if __name__ == "__main__":
    main()
