"""SimHash near-duplicates through a Gray-order hierarchical index.

A text's fingerprint has a bit set where over half of its word-shingle hashes
have it.  The index factors shared bit patterns into nodes: the uppermost nodes
are the values of masks chosen so that any two linked fingerprints agree on at
least one of them (``covering_masks``) or do so with high probability
(``sampled_masks``).  Rows are dealt out by upper node.  Inside a node the
fingerprints are sorted by Gray rank, equal leading 16-bit patterns become inner
nodes, and a search walks down with the differences accumulated so far, leaving
out whole groups once they exceed the radius.

An upper node with more than ``NODE_ROWS`` fingerprints is refined: masks that
cover the bits its own mask leaves open cut it into smaller nodes, again without
losing a pair (``refinements``).  Fingerprints are distinct, so after three levels of
64-bit codes a node has 256 rows at most, and each row is copied a constant number of
times.  A node gives only the links of a spanning forest, never all pairs.

Defined results
* null text is the empty text; texts without words have the fingerprint zero and
  link like any other.
* fewer words than a shingle: the whole sequence is the one shingle.
* repeated rows each have their row; rows with a null id link like any other but
  never name a component: alone, theirs is null.
* ids may be of any type that can be ordered.
* empty tables give empty results; extra columns are never touched.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from platlark.functions.shared import cut
from platlark.llm.joins import spread_join
from platlark.operators.graph import connected_components

NODE_ROWS = 2048
PIECE = 1 << 16


def shingles(text: bytes, size: int) -> Iterator[bytes]:
    """Word shingles, repeats included; A-Z lower-cased, words split at ASCII white space."""
    words = text.lower().split()
    if len(words) <= size:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))


def _hash_bytes(text: bytes, size: int, bits: int) -> bytes:
    if bits == 64:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles(text, size), repeat(42)), dtype=np.uint64)
        return hashes.astype(">u8").tobytes()
    return b"".join(map(xxhash.xxh3_128_digest, shingles(text, size)))


def _majority(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.packbits(2 * counts > n[:, None], axis=1)


def fingerprint_batch(texts: list[bytes | None], size: int, bits: int) -> list[bytes]:
    """Fingerprints as big-endian bytes, the most significant bit first."""
    width, out, held, rows = bits // 8, [], [], 0

    def flush() -> None:
        nonlocal held, rows
        n = np.array([len(x) // width for x in held])
        counts = np.zeros((len(held), bits), dtype=np.int64)
        full = np.flatnonzero(n)
        if len(full):
            flat = np.unpackbits(np.frombuffer(b"".join(held), dtype=np.uint8).reshape(-1, width), axis=1)
            starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
            counts[full] = np.add.reduceat(flat, starts, axis=0, dtype=np.int32)
        out.extend(x.tobytes() for x in _majority(counts, n))
        held, rows = [], 0

    for text in texts:
        data = _hash_bytes(text or b"", size, bits)
        n = len(data) // width
        if n > PIECE:  # a very long text is counted piece by piece
            flush()
            counts = np.zeros(bits, dtype=np.int64)
            for i in range(0, len(data), PIECE * width):
                part = np.frombuffer(data[i : i + PIECE * width], dtype=np.uint8).reshape(-1, width)
                counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
            out.extend(x.tobytes() for x in _majority(counts[None], np.array([n])))
            continue
        held.append(data)
        rows += n
        if rows > PIECE:
            flush()
    if held:
        flush()
    return out


def fingerprints(docs: DataFrame, doc_id: str, text: str, shingle: int, bits: int) -> DataFrame:
    """(id, code): the fingerprint of every row as ``bits // 8`` bytes."""

    def run(batches):
        for b in batches:
            code = fingerprint_batch(b.column(1).to_pylist(), shingle, bits)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(code, pa.binary())], ["id", "code"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("t")).mapInArrow(
        run, f"id {kind}, code binary"
    )


def covering_masks(bits: int, radius: int, blocks: int = 4) -> list[int]:
    """Masks of all but ``radius`` of the blocks: codes that differ in at most ``radius`` bits agree on one."""
    edge = [bits * i // blocks for i in range(blocks + 1)]
    block = [((1 << (edge[i + 1] - edge[i])) - 1) << (bits - edge[i + 1]) for i in range(blocks)]
    return [sum(m) for m in itertools.combinations(block, blocks - radius)]


def refinements(bits: int, radius: int, blocks: int = 4, open_bits: int = 8) -> list[list[tuple[int, int]]]:
    """Levels of (number of the mask above, mask) until a mask leaves at most ``open_bits`` bits open.

    Codes that agree on a mask and differ in at most ``radius`` bits agree on one of
    the masks below it, which add all but ``radius`` blocks of its open bits.
    """
    levels = [[(0, m) for m in covering_masks(bits, radius, blocks)]]
    while bits - levels[-1][0][1].bit_count() > open_bits:
        below = []
        for k, (_, mask) in enumerate(levels[-1]):
            rest = [1 << b for b in reversed(range(bits)) if not mask >> b & 1]
            edge = [len(rest) * i // blocks for i in range(blocks + 1)]
            block = [sum(rest[edge[i] : edge[i + 1]]) for i in range(blocks)]
            below += [(k, mask | sum(m)) for m in itertools.combinations(block, blocks - radius)]
        levels.append(below)
    return levels


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code (rows of big-endian bytes) in the reflected Gray order, as bytes."""
    flat = np.unpackbits(codes, axis=1)
    return np.packbits(np.bitwise_xor.accumulate(flat, axis=1), axis=1)


def node_links(codes: np.ndarray, radius: int, block: int = 256) -> np.ndarray:
    """Spanning forest of the graph of rows that differ in at most ``radius`` bits.

    codes: (m, bytes) uint8, the bytes even in number.  Returns (links, 2) indices.
    """
    m = len(codes)
    order = np.lexsort(gray_rank(codes).T[::-1])
    segments = codes[order].view(">u2").astype(np.uint16)
    depth = segments.shape[1]
    # inner nodes of each level: runs of rows that share all patterns so far
    new = np.zeros(m, dtype=bool)
    new[0] = True
    levels = []
    for s in range(depth):
        new[1:] |= segments[1:, s] != segments[:-1, s]
        first = np.flatnonzero(new)
        levels.append((first, segments[first, s]))
    component = np.arange(m)
    links = []
    for at in range(0, m, block):
        rows = np.arange(at, min(m, at + block))
        first, pattern = levels[0]
        q, g = (x.ravel() for x in np.meshgrid(rows, np.flatnonzero(first <= rows[-1]), indexing="ij"))
        apart = np.zeros(len(q), dtype=np.uint8)
        for s in range(depth):
            first, pattern = levels[s]
            apart = apart + np.bitwise_count(segments[q, s] ^ pattern[g]).astype(np.uint8)
            near = apart <= radius
            q, g, apart = q[near], g[near], apart[near]
            if s + 1 < depth:  # down to the children of the groups that are left
                below = levels[s + 1][0]
                lo = np.searchsorted(below, first[g])
                hi = np.searchsorted(below, np.append(first, m)[g + 1])
                n = hi - lo
                q, apart = np.repeat(q, n), np.repeat(apart, n)
                g = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else g
        first = levels[-1][0]
        size = np.diff(np.append(first, m))[g]
        j = first[g]
        wide = size > 1  # equal codes: they lie side by side
        if wide.any():
            extra = np.concatenate([np.arange(a, a + k) for a, k in zip(j[wide], size[wide], strict=True)])
            q, apart = np.concatenate([q[~wide], np.repeat(q[wide], size[wide])]), np.concatenate(
                [apart[~wide], np.repeat(apart[wide], size[wide])]
            )
            j = np.concatenate([j[~wide], extra])
        keep = j < q
        q, j, apart = q[keep], j[keep], apart[keep]
        while len(q):  # a smaller label that is near joins each larger one
            a, b = component[q], component[j]
            apart_from = a != b
            q, j, apart, a, b = (x[apart_from] for x in (q, j, apart, a, b))
            if not len(q):
                break
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            rank = np.lexsort((apart, lo, hi))  # for each larger label one smaller label
            pick = rank[np.concatenate([[True], hi[rank][1:] != hi[rank][:-1]])]
            links.append(np.stack([q[pick], j[pick]], axis=1))
            parent = np.arange(m)
            parent[hi[pick]] = lo[pick]
            while (parent != parent[parent]).any():
                parent = parent[parent]
            component = parent[component]
    found = np.concatenate(links) if links else np.zeros((0, 2), dtype=int)
    return order[found]


def search(codes: DataFrame, bits: int, radius: int) -> DataFrame:
    """Links (src, dst) between rows of ``codes`` (id, code; codes distinct) within ``radius``, found through the index."""
    lanes = bits // 64
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    lane = lambda k: F.conv(F.hex(F.substring("code", 8 * k + 1, 8)), 16, -10).cast("long")
    names = [f"c{k}" for k in range(lanes)]
    rows = codes.select("id", "code", *[lane(k).alias(c) for k, c in enumerate(names)], F.lit(0).alias("above"))
    levels, found = refinements(bits, radius), []
    for level, masks in enumerate(levels):
        below: dict[int, list] = {}
        for i, (above, m) in enumerate(masks):
            parts = [signed((m >> (64 * (lanes - 1 - k))) & ((1 << 64) - 1)) for k in range(lanes)]
            below.setdefault(above, []).append(F.struct(F.lit(i).alias("i"), *[F.lit(x).cast("long").alias(f"m{k}") for k, x in enumerate(parts)]))
        table = F.array(*[F.array(*below[k]) for k in sorted(below)])
        rows = rows.select("id", "code", *names, F.explode(F.get(table, F.col("above"))).alias("m"))
        key: Column = F.xxhash64(F.lit(level), "m.i", *[F.col(c).bitwiseAND(F.col(f"m.m{k}")) for k, c in enumerate(names)])
        rows = rows.select("id", "code", *names, F.col("m.i").alias("above"), key.alias("part"))
        size = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        over = cut(size.filter(F.col("n") > NODE_ROWS).select("part")) if level + 1 < len(levels) else None
        if over is None or not over.head(1):
            found.append(rows.join(size, "part").select("part", "id", "code"))
            break
        found.append(rows.join(size.filter(F.col("n") <= NODE_ROWS), "part").select("part", "id", "code"))
        rows = cut(rows.join(over, "part", "left_semi").select("id", "code", *names, "above"))
    rows = functools.reduce(DataFrame.union, found)
    n = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "part").sortWithinPartitions("part", "code", "id")
    width = bits // 8

    def links(batches):
        rest = None
        for b in itertools.chain(batches, [None]):
            t = rest if b is None else pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b])
            if t is None or not len(t):
                continue
            part = t.column(0).to_numpy()
            end = len(part) if b is None else int(np.flatnonzero(np.append(True, part[1:] != part[:-1]))[-1])
            rest = t.slice(end).combine_chunks()
            if end < 2:
                continue
            part, ids = part[:end], t.column(1).to_numpy()[:end]
            code = np.frombuffer(b"".join(t.column(2).slice(0, end).to_pylist()), dtype=np.uint8).reshape(-1, width)
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            size = np.diff(np.append(first, end))
            two = first[size == 2]
            close = np.bitwise_count(code[two] ^ code[two + 1]).sum(axis=1) <= radius
            found = [np.stack([two[close], two[close] + 1], axis=1)]
            found += [f + node_links(np.ascontiguousarray(code[f : f + k]), radius) for f, k in zip(first[size > 2], size[size > 2], strict=True)]
            pairs = ids[np.concatenate(found)]
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])

    return dealt.mapInArrow(links, "src long, dst long")


def components(docs: DataFrame, doc_id="doc_id", text="text", shingle=3, bits=64, radius=2) -> DataFrame:
    """(id, code, component): every row's fingerprint and the smallest id reachable over links."""
    codes = cut(fingerprints(docs, doc_id, text, shingle, bits))
    distinct = codes.groupBy("code").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    rows = cut(distinct.withColumn("at", F.monotonically_increasing_id()))  # numbered, so that ids may be of any type
    found = connected_components(search(rows.select(F.col("at").alias("id"), "code"), bits, radius))
    placed = rows.join(found, rows["at"] == found["node"], "left").select("code", "id", "n", F.coalesce("component", "at").alias("group"))
    placed = cut(placed)
    least = placed.groupBy("group").agg(F.min("id").alias("component"))
    labels = cut(placed.join(least, "group").select("code", "component", "n"))
    return spread_join(codes, labels, ["code"], "n").select("id", "code", "component")
