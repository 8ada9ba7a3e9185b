"""Document fingerprints by I-Match over randomised lexicon subsets.

Terms are words (runs of non-white-space bytes, A-Z lower-cased), known by a 64-bit
hash.  The lexicon holds the terms whose document frequency lies in a band; as no
more than (distinct terms of a mean document) / ``low`` terms can reach the share
``low``, its size is bounded whatever the corpus, and it is sent to all tasks.  A
text keeps its lexicon terms, sorted and distinct; each randomised subset of the
lexicon gives a hash of the kept terms inside it.  The first subset is the whole
lexicon; the others keep a 16th, a 64th, a 256th or a 1024th of the terms, so that
short and long texts both have subsets that a local change leaves alone.  The
likeness of two fingerprints is the share of equal hashes among the subsets that
hold a term of either text.

A text without any lexicon term is fingerprinted over all its terms.

Next documents are found without a global window: rows are dealt by ranges of
descending (id, text hash), and the first row of each range is sent to the range before
as well.  Null ids sort last; as the text's hash takes part, neither they nor the rows of
one repeated id have to meet in one task.

Defined results
* null text is the empty text (fingerprint of empty subsets); texts without terms
  are alike to each other (1.0) and to nothing else (0.0).
* equal texts have equal fingerprints.
* rows with one id, and those without, are ordered by their text's hash; null ids come last; a table of
  one row has itself as next document; an empty table gives an empty result.
* extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

#: Each subset keeps one lexicon term in 2 ** rate.
RATES = (0,) + (4,) * 15 + (6,) * 16 + (8,) * 16 + (10,) * 16
DIGITS = 4


@dataclass(frozen=True)
class MatchParams:
    """Shares of documents between which a term's document frequency must lie."""

    low: float = 0.001
    high: float = 0.2
    min_df: int = 2


def term_hashes(text: bytes) -> np.ndarray:
    """Hashes of the distinct terms, sorted."""
    terms = set(text.lower().split())
    out = np.fromiter(map(xxhash.xxh64_intdigest, terms, repeat(7)), dtype=np.uint64, count=len(terms))
    out.sort()
    return out


def document_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """(term, df): counted in each task first, in dictionaries of bounded size."""

    def run(batches):
        def batch(counts):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.fromiter(counts.keys(), np.uint64, len(counts)).view(np.int64)), pa.array(list(counts.values()), pa.int64())],
                ["term", "df"],
            )

        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update(term_hashes(t or b"").tolist())
                if len(counts) > 300_000:
                    yield batch(counts)
                    counts.clear()
        if counts:
            yield batch(counts)

    parts = docs.select(F.col(text).cast("binary").alias("t")).mapInArrow(run, "term long, df long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, text: str, params: MatchParams) -> np.ndarray:
    """Sorted hashes of the terms inside the band."""
    n = docs.count()
    band = document_frequencies(docs, text).filter(
        (F.col("df") >= max(params.min_df, params.low * n)) & (F.col("df") <= max(params.min_df, params.high * n))
    )
    found = band.select("term").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)
    return np.sort(found)


def subset_masks(terms: np.ndarray) -> np.ndarray:
    """For each term a bit for each subset that keeps it."""
    out = np.zeros(len(terms), dtype=np.uint64)
    for k, rate in enumerate(RATES):
        x = (terms ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        out |= ((x >> np.uint64(40)) % np.uint64(1 << rate) == 0).astype(np.uint64) << np.uint64(k)
    return out


def memberships(terms: np.ndarray) -> np.ndarray:
    """(term, subset): whether the subset keeps the term."""
    return np.unpackbits(subset_masks(terms)[:, None].view(np.uint8), axis=1, bitorder="little").astype(bool)


def fingerprint(text: bytes, words: np.ndarray, held: np.ndarray) -> str:
    """One hash of ``DIGITS`` hex digits for each subset; dashes where it keeps none of the terms.

    words: the sorted lexicon; held: its ``memberships``.
    """
    all_terms = term_hashes(text)
    kept, member = all_terms, None
    if len(words) and len(all_terms):
        at = np.minimum(np.searchsorted(words, all_terms), len(words) - 1)
        found = words[at] == all_terms
        if found.any():
            kept, member = all_terms[found], held[at[found]]
    if member is None:
        member = memberships(kept)
    out = []
    for k in range(len(RATES)):
        inside = kept[member[:, k]]
        out.append(f"{xxhash.xxh64_intdigest(inside.tobytes()) & 0xFFFF:04x}" if len(inside) else "-" * DIGITS)
    return "".join(out)


def likeness(a: str, b: str) -> float:
    parts = [(a[i : i + DIGITS], b[i : i + DIGITS]) for i in range(0, len(a), DIGITS)]
    held = [x == y for x, y in parts if x[0] != "-" or y[0] != "-"]
    return sum(held) / len(held) if held else 1.0


def compare_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: MatchParams = MatchParams()) -> DataFrame:
    """Fingerprints of every text and of the text with its second half taken from the next document."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    words = lexicon(rows, "t", params)
    # among rows of one id the smallest text hash comes first: flipped, it descends like the id
    rows = rows.withColumn("flip", F.bitwise_not(F.xxhash64("t")))

    def place(i, flip) -> tuple:
        return (0, 0, flip) if i is None else (1, i, flip)

    # bounds of the ranges, from a bounded sample
    total = rows.count()
    seen = rows.select("id", "flip").sample(min(1.0, 200.0 * n / max(1, total)), 5).limit(1000 * n).collect()
    seen = sorted(place(*r) for r in seen)
    bounds = sorted({seen[len(seen) * i // n] for i in range(1, n)}) if seen else []

    def part_of(i, flip) -> int:
        return len(bounds) - bisect.bisect_right(bounds, place(i, flip))

    def parts(batches):
        for b in batches:
            at = map(part_of, b.column(0).to_pylist(), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column(0), b.column(1)], ["part", "id", "flip"])

    # the first row of each range: as many rows as there are ranges
    top = F.max(F.struct(F.col("id").isNotNull().alias("has"), "id", "flip")).alias("top")
    found = rows.select("id", "flip").mapInArrow(parts, f"part int, id {kind}, flip long").groupBy("part").agg(top).collect()
    heads = {r["part"]: place(r["top"]["id"], r["top"]["flip"]) for r in found}
    order = sorted(heads)
    before = {p: order[k - 1] for k, p in enumerate(order)}

    def deal(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            out, at = [], []
            for k, (i, t, flip) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                data = pack((t or "").encode())
                p = part_of(i, flip)
                at.append(k)
                out.append((p, 0, data))
                if place(i, flip) == heads[p]:
                    at.append(k)
                    out.append((before[p], 1, data))
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), b.column(0).take(index), b.column(2).take(index), pa.array(cols[2], pa.binary())],
                ["part", "carry", "id", "flip", "z"],
            )

    dealt = (
        rows.mapInArrow(deal, f"part int, carry int, id {kind}, flip long, z binary")
        .repartitionById(len(bounds) + 1, "part")  # a range is a task
        .sortWithinPartitions("part", "carry", F.desc_nulls_last("id"), F.desc("flip"), "z")
        .drop("flip")
    )

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        held_by = memberships(words)
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held, last = [], None

        def judged(own, nxt):
            i, a, fa = own
            half = len(a) // 2
            edited = (a[: len(a) - half] + nxt[1][:half]).encode()
            fe = fingerprint(edited, words, held_by)
            return i, len(a), hashlib.sha256(edited).hexdigest(), fa, fe, likeness(fa, fe), likeness(fa, nxt[2])

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

        for b in batches:
            types[0] = b.column(2).type
            for p, carry, i, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if carry and (last is None or last[0] != p):
                    continue  # only the first carried row is the next document
                data = unpack(z) if z else b""
                row = (i, data.decode(), fingerprint(data, words, held_by))
                if last is not None and last[0] == p:
                    held.append(judged(last[1], row))
                last = None if carry else (p, row)
                if len(held) >= 2000:
                    yield batch()
                    held = []
        if held:
            yield batch()

    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, schema).withColumnRenamed("id", doc_id)
