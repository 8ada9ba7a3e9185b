"""Substring dedup: repeated runs of consecutive sentences are removed after their first place.

Every run of three consecutive sentences is hashed over its words, lower-cased, and so
are shorter ones that are long enough by themselves (``RUNS``: two sentences with 16
words, one with 40); longer repeats are covered by those of three.  Runs are joined by
hash over the whole corpus; the first place of a run is the one with the smallest (id,
text hash, sentence number).  A sentence covered by any other place of a repeated run is
removed, together with the white space after it.

Runs are hashed once and staged.  The first place is found by an aggregation with
map-side minima and joined back; runs that hold more than a thousandth of all places
are joined by broadcast where their places lie (``spread_join``), so a passage that
very many documents hold is never gathered in one task.

Sentences end after ``.``, ``!`` or ``?`` before white space, and at line ends.

Defined results
* null and empty texts have no sentences and come back unchanged.
* of equal texts the one with the smallest id keeps its runs.
* a row is a document: of rows that share an id each has places of its own; only rows
  equal in id and text are one, and keep the same.  Rows with a null id are neither
  compared nor changed.
* extra columns are carried, ``n_sentences`` and ``n_removed`` replace columns of
  those names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from platlark.functions.shared import staged
from platlark.llm.joins import spread_join

#: Sentences in a run -> fewest words that make it a run; three sentences always are one.
RUNS = {1: 40, 2: 16, 3: 0}
_GAP = re.compile(r"(?<=[.!?])[ \t\r\f\v\n]+|\n+")


def sentences(text: str) -> list[tuple[int, int, int]]:
    """(start, end, start of the next) of every sentence, white space between them left out."""
    out, at = [], 0
    for gap in _GAP.finditer(text):
        if gap.start() > at:
            out.append((at, gap.start(), gap.end()))
        elif out:
            out[-1] = (*out[-1][:2], gap.end())
        at = gap.end()
    if at < len(text):
        out.append((at, len(text), len(text)))
    return out


def runs(text: str) -> list[tuple[int, int, int]]:
    """(hash, first sentence, sentences) of every run."""
    parts, sizes = [], []
    for a, b, _ in sentences(text):
        words = text[a:b].lower().split()
        sizes.append(len(words))
        parts.append(xxhash.xxh3_128_digest(" ".join(words)))
    out = []
    for n, least in RUNS.items():
        for i in range(len(parts) - n + 1):
            if sum(sizes[i : i + n]) >= least:
                out.append((xxhash.xxh3_128_digest(b"".join(parts[i : i + n])), i, n))
    return out


def text_hash(text: Column) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(text)


def find_repeats(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, th, places): for each document the runs (sentence * 4 + length) to remove; th: its text's hash."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def hashed(batches):
        for b in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
            at, rows = [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                for digest, first, n in runs(t):
                    at.append(i)
                    rows.append((*struct.unpack("<qq", digest), first * 4 + n))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            own = [b.column(k).take(pa.array(at, pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())],
                ["id", "th", "h", "g", "place"],
            )

    own = docs.select(F.col(doc_id).alias("id"), text_hash(F.col(text)).alias("th"), F.col(text).alias("t")).filter("id is not null and t <> ''")
    spans = staged(own.mapInArrow(hashed, f"id {kind}, th long, h long, g long, place int"), "runs", "zstd")
    first = spans.groupBy("h", "g").agg(F.min(F.struct("id", "th", "place")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = staged(first, "repeated")
    later = spread_join(spans, first, ["h", "g"], "n").filter("first.id <> id or first.th <> th or first.place <> place")
    return later.groupBy("id", "th").agg(F.collect_set("place").alias("places"))


def strip(text: str, places) -> tuple[str, int, int]:
    """The text without the covered sentences; how many sentences it had and lost."""
    parts = sentences(text)
    gone = {i for p in places for i in range(p // 4, p // 4 + p % 4)}
    out, at = [], 0
    for i, (a, _, nxt) in enumerate(parts):
        if i in gone:
            out.append(text[at:a])
            at = nxt
    out.append(text[at:])
    return "".join(out), len(parts), len(gone)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, and n_sentences, n_removed."""
    names = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    found = find_repeats(docs, doc_id, text).withColumnsRenamed({"id": "__s_id", "th": "__s_th", "places": "__s_places"})
    own = docs.select(*[F.col(f"`{c}`") for c in names])
    same = (F.col(doc_id) == F.col("__s_id")) & (text_hash(F.col(text)) == F.col("__s_th"))
    rows = own.filter(F.col(doc_id).isNotNull()).join(found, same, "left").drop("__s_id", "__s_th")
    # rows without an id meet nothing, so they stay where they are
    rows = rows.unionByName(own.filter(F.col(doc_id).isNull()).withColumn("__s_places", F.lit(None).cast("array<int>")))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        for b in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
            col = names.index(text)
            texts, places = b.column(col).to_pylist(), b.column(len(names)).to_pylist()
            done = [strip(t, p) if t and p else (t, len(sentences(t)) if t else 0, 0) for t, p in zip(texts, places, strict=True)]
            arrays = [b.column(i) for i in range(len(names))]
            arrays[col] = pa.array([d[0] for d in done], arrays[col].type)
            counts = [pa.array([d[k] for d in done], pa.int32()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([*arrays, *counts], [*names, "n_sentences", "n_removed"])

    return rows.mapInArrow(run, f"{fields}, n_sentences int, n_removed int")
