"""URL filters: prefix rules as intervals of reversed-host keys, judged in one sorted sweep.

A rule is a host and a path prefix; it fits its host and all subdomains when the
url's path starts with the rule's path.  The canonical key of a host is its labels
in reverse order, each ended by a byte that sorts before every label byte, so a
rule's host is the interval of keys that start with its key.  Urls and rules are
dealt out by ranges of these keys and each range is swept in key order with a
stack of the active, nested rules.

Rules are cut at the range boundaries (a rule goes to every range that its
interval meets), so no range depends on another.  Boundaries are taken from a
sample of (key, id hash) pairs: one host with very many urls spans many ranges.

Defined results
* null url, or one without ``://``: host and path are empty and no rule fits.
* of the fitting rules the longest wins: most host characters and path characters
  together, then the longer host, then block before allow.
* no fitting rule: ``default`` decides (allow).
* repeated urls or ids are judged row by row; repeated rules count once; rules
  with a null host or path are read as empty strings; an empty rule host fits every
  host.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "\x01"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.locate("://", url)
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by ``END``; the empty host is the empty key."""
    labels = F.reverse(F.split(host, "\\."))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(labels, END), F.lit(END)))


def _key(host: str) -> str:
    return "".join(x + END for x in reversed(host.split("."))) if host else ""


def sweep(rows, default: str):
    """Verdicts for (key, kind, ...) rows in key order; rules of a key come before its urls.

    The stack holds the active rules' nodes: one for each host key that is a prefix
    of the present key, with its paths by length.
    """
    stack: list[tuple[str, dict[str, str], list[int]]] = []
    for key, is_rule, payload in rows:
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if is_rule:
            host, path, action = payload
            if not stack or stack[-1][0] != key:
                stack.append((key, {}, []))
            paths, sizes = stack[-1][1:]
            if path not in paths:
                paths[path] = (action, host)
                if len(path) not in sizes:
                    bisect.insort(sizes, len(path))
            elif action == "block":
                paths[path] = (action, host)
            continue
        row, path = payload
        best = None
        for _, paths, sizes in reversed(stack):
            for n in reversed(sizes[: bisect.bisect_right(sizes, len(path))]):
                hit = paths.get(path[:n])
                if hit:
                    rank = (len(hit[1]) + n, len(hit[1]))
                    if best is None or rank > best[0]:
                        best = (rank, hit[1] + path[:n], hit[0])
                    break
        yield row, (best[1], best[2]) if best else (None, default)


def judge(
    pages: DataFrame, rules: DataFrame, row_id="page_id", url="url", default="allow", ranges: int | None = None
) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``.

    ``rules`` has the columns action (block or allow), host and path.
    """
    spark = pages.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own_kind = pages.schema[row_id].dataType.simpleString()
    kind = own_kind if own_kind in ("bigint", "int", "string") else "string"  # other ids travel as text
    urls = pages.select(F.col(row_id).cast(kind).alias("id"), F.col(url).alias("url"))
    urls = urls.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.select(
        "id", "host", "path", host_key(F.col("host")).alias("key"), F.xxhash64("id", "path").alias("salt")
    )
    # boundaries of the ranges: quantiles of a bounded sample, never the rows themselves
    total = urls.count()
    share = min(1.0, 100.0 * n / max(total, 1))
    seen = urls.select("key", "salt").sample(share, 11).limit(400 * n).collect() if n > 1 else []
    seen = sorted((r["key"], r["salt"]) for r in seen)
    bounds = sorted({seen[len(seen) * i // n] for i in range(1, n)}) if seen else []
    keys = [b[0] for b in bounds]

    def deal_urls(batches):
        for b in batches:
            key, salt = b.column("key").to_pylist(), b.column("salt").to_pylist()
            part = [bisect.bisect_right(bounds, x) for x in zip(key, salt, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), b.column("key"), pa.array([1] * len(part), pa.int32()), b.column("id"), b.column("host"), b.column("path"), pa.nulls(len(part), pa.string())],
                ["part", "key", "kind", "id", "host", "path", "action"],
            )

    def deal_rules(batches):
        for b in batches:
            out = []
            for host, path, action in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                key = _key(host)
                lo = bisect.bisect_left(keys, key)  # first range that can hold the key itself
                hi = bisect.bisect_left(keys, key[:-1] + chr(ord(END) + 1)) if key else len(keys)
                out += [(p, key, 0, host, path, action) for p in range(lo, hi + 1)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            part, key, k, host, path, action = (pa.array(list(c), t) for c, t in zip(cols, types, strict=True))
            yield pa.RecordBatch.from_arrays(
                [part, key, k, pa.nulls(len(part), id_type), host, path, action],
                ["part", "key", "kind", "id", "host", "path", "action"],
            )

    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    schema = f"part int, key string, kind int, id {kind}, host string, path string, action string"
    clean = rules.select(
        F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action"
    ).distinct()
    both = urls.mapInArrow(deal_urls, schema).union(clean.mapInArrow(deal_rules, schema))
    both = both.repartitionById(n, "part").sortWithinPartitions("part", "key", "kind", "host", "path")

    def run(batches):
        def rows():
            last = None
            for b in batches:
                cols = [b.column(i).to_pylist() for i in range(7)]
                for part, key, k, i, host, path, action in zip(*cols, strict=True):
                    if part != last:  # the next range begins with an empty stack
                        last = part
                        yield "\x00", True, ("", "\x00", default)
                    yield key, not k, (host, path, action) if not k else ((i, host, path), path)

        held: list[tuple] = []

        def batch():
            i, host, path, rule, verdict = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(i, id_type), *(pa.array(x, pa.string()) for x in (host, path, rule, verdict))],
                ["id", "host", "path", "rule", "verdict"],
            )

        for row, verdict in sweep(rows(), default):
            held.append((*row, *verdict))
            if len(held) == 10_000:
                yield batch()
                held = []
        if held:
            yield batch()

    out = both.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string")
    return out.withColumn("id", F.col("id").cast(own_kind))
