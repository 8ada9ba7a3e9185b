"""Substring dedup by suffix order: bytes inside a string of ``match`` bytes that also starts in an earlier document go.

Two equal strings have equal suffix neighbours, so the order of all suffixes tells what
repeats.  It is built where it can say something, and in pieces that Spark deals out:

1. Documents are packed into compressed blocks, written once; a place is (block, row,
   start).  Every window of ``match`` bytes is keyed by the least hash of the
   ``anchor``-byte strings inside it, which depends on the window alone, so equal windows
   have equal keys.  Neighbouring windows of one key are a segment, up to 32 windows.
2. Segments meet by key.  A segment equal to that of an earlier document goes whole.
   Keys of one document have nothing to compare.  Where one key has different segments,
   one of each, with its earliest document, enters a collection.
3. The collection's Burrows-Wheeler transform is built column by column: round j inserts
   the symbol before each string's last j bytes, at the place that the counts of equal
   symbols before its last one give, and puts the common prefix with either neighbour
   right.  Transform, prefixes (up to ``match``) and origins are files that every round
   reads and writes once from front to end; memory holds a few numbers for each string.
   Windows with a common prefix of ``match`` or more are one string; its earliest
   document decides.
4. Decisions return to the blocks, which give the spans and the bytes that are kept.

Keys and segments are compared by hashes of 48 bits each; strings inside a collection are
compared symbol by symbol.  Before the shuffle, equal segments of about 8 MB of text are
settled among themselves and one goes on, so a passage in a third of all documents is no
hot key.  Keys with very many different segments around them (a common phrase) are found
on a bounded sample; their windows are dealt one by one by hashes of their own.  The
sample decides how rows travel, never what is found.  The files of a collection belong to
a task and go with it.

Defined results
* null texts are empty; texts shorter than ``match`` bytes are never changed.
* a document is a row; rows of one id do not count as earlier than each other, rows
  without an id are neither earlier nor changed; of equal texts the smallest id stays.
* ids are whole numbers of up to 64 bits; other columns are ignored; an empty table gives
  an empty result.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from platlark.functions.shared import staged

#: Windows in a segment: a bit each.
WINDOWS = 32
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)
_LOW48 = np.uint64((1 << 48) - 1)


@dataclass(frozen=True)
class SuffixParams:
    """``match``: bytes that make a repeat; ``anchor``: bytes of a key's string, at most ``match``.

    block_bytes, group_blocks: texts in a block, blocks settled together before the shuffle;
    part_bytes: texts whose segments meet in one task; collection: strings in a collection;
    sample_blocks, crowd: a key with more different segments than ``crowd`` in that many blocks is dealt by windows.
    """

    match: int = 50
    anchor: int = 16
    block_bytes: int = 1 << 20
    group_blocks: int = 8
    part_bytes: int = 32 << 20
    collection: int = 20_000
    sample_blocks: int = 64
    crowd: int = 500


# ---- arrays in rows --------------------------------------------------------


def _pack(cols: dict[str, np.ndarray]) -> bytes:
    """Columns of whole numbers, differences of neighbours, bytes of equal weight together."""
    parts = []
    for a in cols.values():
        d = a.copy()
        d[1:] -= a[:-1]
        parts.append(d.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.compress(b"".join(parts), 1)


def _unpack(blob: bytes, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    raw, out, at = np.frombuffer(zstandard.decompress(blob), np.uint8), {}, 0
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds.values())
    for name, kind in kinds.items():
        size = np.dtype(kind).itemsize
        d = np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).reshape(-1).view(kind)
        out[name] = np.cumsum(d, dtype=kind)
        at += n * size
    return out


def _joined(parts: list[dict[str, np.ndarray]], kinds: dict[str, str]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.empty(0, t) for k, t in kinds.items()}


def _taken(cols: dict[str, np.ndarray], at) -> dict[str, np.ndarray]:
    return {k: a[at] for k, a in cols.items()}


PLACE = {"id": "i8", "block": "i8", "row": "i4", "start": "i4", "count": "u1"}
TOLD = {"row": "i4", "start": "i4", "mask": "u4"}
ASKED = {"row": "i4", "start": "i4", "count": "u1", "key": "u8", "id": "i8"}


def _runs(a: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values."""
    return np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)


# ---- blocks and segments ---------------------------------------------------


def _blocks(docs: DataFrame, doc_id: str, text: str, params: SuffixParams) -> DataFrame:
    """(block, ids, known, sizes, texts): documents packed together, in the order of the scan."""

    def run(batches):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 33, [], 0

        def block():
            ids, texts = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number]),
                    pa.array([_pack({"id": np.array([i or 0 for i in ids], np.int64)})], pa.binary()),
                    pa.array([np.packbits([i is not None for i in ids]).tobytes()], pa.binary()),
                    pa.array([_pack({"n": np.array([len(t) for t in texts], np.int64)})], pa.binary()),
                    pa.array([zstandard.compress(b"".join(texts), 3)], pa.binary()),
                ],
                ["block", "ids", "known", "sizes", "texts"],
            )

        for b in (x.slice(i, 100) for x in batches for i in range(0, x.num_rows, 100)):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append((i, t or b""))
                size += len(held[-1][1])
                if size >= params.block_bytes or len(held) >= 20_000:
                    yield block()
                    number, held, size = number + 1, [], 0
        if held:
            yield block()

    rows = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string").cast("binary"))
    return staged(rows.mapInArrow(run, "block long, ids binary, known binary, sizes binary, texts binary"), "blocks", "none")


def _opened(ids: bytes, known: bytes, sizes: bytes, texts: bytes):
    """(ids, whether known, where each text starts in the bytes, the bytes)."""
    n = _unpack(sizes, {"n": "i8"})["n"]
    bits = np.unpackbits(np.frombuffer(known, np.uint8), count=len(n)).astype(bool)
    return _unpack(ids, {"id": "i8"})["id"], bits, np.r_[0, np.cumsum(n)], np.frombuffer(zstandard.decompress(texts), np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class _Hashes:
    """Hashes of any stretch of a block's bytes, from running sums."""

    powers = inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(_Hashes.powers) < n:
            _Hashes.powers = np.cumprod(np.r_[np.uint64(1), np.full(n, _P, np.uint64)])
            _Hashes.inverses = np.cumprod(np.r_[np.uint64(1), np.full(n, _INVERSE, np.uint64)])
        self.sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: n - 1])]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverses[start])

    def all_of(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.inverses[:n])


def _segments(opened, block: int, crowded: np.ndarray, params: SuffixParams):
    """(key, segment hash, places) of one block."""
    ids, known, at, data = opened
    m, width = params.match, params.match - params.anchor + 1
    none = {k: np.empty(0, t) for k, t in PLACE.items()}
    if len(data) < m:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), none
    hashes = _Hashes(data)
    least, size = hashes.all_of(params.anchor), 1
    while size * 2 <= width:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    row = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(at))[: len(least)]
    inside = (np.arange(len(least)) + m <= at[1:][row]) & known[row]
    first = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])])
    last = np.r_[first[1:], len(least)]
    first, last = first[inside[first]], last[inside[first]]
    keys = least[first]
    if len(crowded):
        one = crowded[np.minimum(np.searchsorted(crowded, keys & _LOW48), len(crowded) - 1)] == keys & _LOW48
        limit = np.where(one, 1, WINDOWS)
    else:
        one, limit = None, np.full(len(keys), WINDOWS)
    pieces = -(-(last - first) // limit)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(first, pieces) + nth * np.repeat(limit, pieces)
    count = np.minimum(np.repeat(last, pieces) - start, np.repeat(limit, pieces))
    keys = np.repeat(keys, pieces)
    segment = hashes.of(start, start + count + m - 1)
    if one is not None:
        keys = np.where(np.repeat(one, pieces), _mix(segment ^ np.uint64(_P)), keys)
    own = row[start]
    places = {
        "id": ids[own], "block": np.full(len(own), block, np.int64), "row": own, "start": (start - at[own]).astype(np.int32), "count": count.astype(np.uint8),
    }
    return keys & _LOW48, segment & _LOW48, places


def _first_of(key, segment, ids):
    """Order by (key, segment, id), starts of equal (key, segment) in it, and for each row of it the smallest id."""
    order = np.lexsort((ids, segment, key))
    k, s = key[order], segment[order]
    starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])]) if len(k) else np.empty(0, np.int64)
    return order, starts, np.repeat(ids[order][starts], np.diff(np.r_[starts, len(k)]))


def _crowded(blocks: DataFrame, params: SuffixParams) -> np.ndarray:
    """Keys with more than ``crowd`` different segments in a sample of ``sample_blocks`` blocks; the sample bounds their number."""
    n = blocks.count()
    sample = blocks.filter(F.pmod(F.xxhash64("block"), F.lit(max(1, n // params.sample_blocks))) == 0)

    def run(batches):
        for b in (x.slice(i, 1) for x in batches for i in range(x.num_rows)):
            block, *parts = (c[0].as_py() for c in b.columns)
            key, segment, _ = _segments(_opened(*parts), block, np.empty(0, np.uint64), params)
            both = np.unique(np.stack([key, segment], axis=1), axis=0) if len(key) else np.empty((0, 2), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, i].astype(np.int64)) for i in (0, 1)], ["k", "s"])

    found = sample.mapInArrow(run, "k long, s long").distinct().groupBy("k").count().filter(F.col("count") > params.crowd)
    return np.sort(found.select("k").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def _dealt(blocks: DataFrame, parts: int, crowded: np.ndarray, params: SuffixParams) -> DataFrame:
    """(part, hashes, places, block, told): segments on their way to their key's part, and what equal ones settled already."""
    sent = blocks.sparkSession.sparkContext.broadcast(crowded)

    def group(held):
        key, segment = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        places = _joined([h[2] for h in held], PLACE)
        order, _, first = _first_of(key, segment, places["id"])
        stays = np.zeros(len(key), bool)
        stays[order] = places["id"][order] == first
        yield from _told_rows(_taken(places, ~stays), parts)
        at = np.flatnonzero(stays)
        part = (_mix(key[at]) % np.uint64(parts)).astype(np.int32)
        at = at[np.argsort(part, kind="stable")]
        part = np.sort(part)
        cuts = np.r_[_runs(part), len(part)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = at[a:b]
            hashes = np.concatenate([x[own].view(np.uint8).reshape(-1, 8)[:, :6] for x in (key, segment)], axis=1)
            yield int(part[a]), hashes.tobytes(), _pack(_taken(places, own)), None, None

    def run(batches):
        held = []
        for b in (x.slice(i, 1) for x in batches for i in range(x.num_rows)):
            block, *parts_ = (c[0].as_py() for c in b.columns)
            held.append(_segments(_opened(*parts_), block, sent.value, params))
            if len(held) >= params.group_blocks:
                yield from _batches(group(held), DEALT)
                held = []
        if held:
            yield from _batches(group(held), DEALT)

    return blocks.mapInArrow(run, DEALT)


DEALT = "part int, hashes binary, places binary, block long, told binary"
ANSWERS = "block long, told binary, asked binary"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batches(rows, schema: str) -> Iterator[pa.RecordBatch]:
    """Rows of a schema in batches of up to 64."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    held: list = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], list(names))

    for r in rows:
        held.append(r)
        if len(held) == 64:
            yield batch()
            held = []
    if held:
        yield batch()


def _told_rows(places: dict[str, np.ndarray], parts: int):
    """Whole segments that go, by block, on any part."""
    order = np.lexsort((places["start"], places["row"], places["block"]))
    p = _taken(places, order)
    cuts = np.r_[_runs(p["block"]), len(order)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        block = int(p["block"][a])
        mask = ((np.uint64(1) << p["count"][a:b].astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
        yield hash(block) % parts, None, None, block, _pack({"row": p["row"][a:b], "start": p["start"][a:b], "mask": mask})


# ---- meeting by key --------------------------------------------------------


def _decided(dealt: DataFrame) -> DataFrame:
    """(block, told, asked): segments that go, and those whose windows a collection has to compare."""

    def decide(hashes, places):
        h = np.zeros((len(hashes), 16), np.uint8)
        h[:, :6], h[:, 8:14] = hashes[:, :6], hashes[:, 6:]
        h = h.view(np.uint64)
        key, segment = h[:, 0], h[:, 1]
        order, starts, first = _first_of(key, segment, places["id"])
        p, key = _taken(places, order), key[order]
        later = p["id"] != first
        own = _runs(key)  # keys, over the rows
        sizes = np.diff(np.r_[own, len(key)])
        kind = np.zeros(len(key), np.int64)
        kind[starts] = 1
        kinds, lo, hi = (f.reduceat(a, own) if len(key) else own for f, a in ((np.add, kind), (np.minimum, first), (np.maximum, first)))
        open_ = np.repeat((kinds > 1) & (lo < hi), sizes) & ~later
        return _taken(p, later), _taken(p, open_), key[open_]

    def run(batches):
        hashes, places = [], []
        for b in batches:
            for h, p, block, told in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                if told is not None:
                    yield from _batches([(block, told, None)], ANSWERS)
                else:
                    hashes.append(np.frombuffer(h, np.uint8).reshape(-1, 12))
                    places.append(_unpack(p, PLACE))
        if not hashes:
            return
        gone, open_, key = decide(np.concatenate(hashes), _joined(places, PLACE))
        del hashes, places
        yield from _batches(((block, told, None) for *_, block, told in _told_rows(gone, 1)), ANSWERS)
        order = np.lexsort((open_["start"], open_["row"], open_["block"]))
        open_, key = _taken(open_, order), key[order]
        cuts = np.r_[_runs(open_["block"]), len(key)]
        cols = open_ | {"key": key}
        rows = ((int(open_["block"][a]), None, _pack({k: cols[k][a:b] for k in ASKED})) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        yield from _batches(rows, ANSWERS)

    return staged(dealt.mapInArrow(run, ANSWERS), "answers")


# ---- collections -----------------------------------------------------------


def _least_to(a: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The smallest of ``a[: end + 1]`` for each end."""
    order = np.argsort(ends)
    cuts = np.r_[0, ends[order][:-1] + 1]
    out = np.empty(len(ends), a.dtype)
    out[order] = np.minimum.accumulate(np.minimum.reduceat(a[: int(ends.max()) + 1], np.minimum(cuts, int(ends.max()))))
    return out


class Collection:
    """Suffix order of many short strings: transform, common prefixes and origins in files, one symbol of each string a round."""

    #: Symbols that are read and written at once.
    STEP = 1 << 18

    def __init__(self, strings: np.ndarray, sizes: np.ndarray, depth: int, folder: str):
        """strings: a row each, right-aligned, bytes plus one, 0 before them; depth: where common prefixes stop."""
        self.strings, self.sizes, self.depth, self.folder, self.turn = strings, sizes, depth, folder, 0
        n, self.width = strings.shape
        self.totals = np.bincount(strings[:, -1], minlength=256)
        self.n, self.origins = n, False
        self._path("symbols").write_bytes(strings[:, -1].tobytes())
        self._path("prefixes").write_bytes(bytes(n))
        self.at, self.owner = np.arange(n), np.arange(n)
        for length in range(1, self.width + 1):
            self._round(length)

    def _path(self, name: str, ahead: int = 0):
        from pathlib import Path

        return Path(self.folder) / f"{name}-{(self.turn + ahead) % 2}"

    def _parts(self, names: dict[str, str]):
        """Blocks of the named files, front to end."""
        files = [self._path(k).open("rb") for k in names]
        try:
            for lo in range(0, self.n, self.STEP):
                yield lo, *(np.fromfile(f, t, min(self.STEP, self.n - lo)) for f, t in zip(files, names.values(), strict=True))
        finally:
            for f in files:
                f.close()

    def _places(self):
        """Where the longer suffixes come, and the common prefixes that change: both in the new order."""
        before = np.r_[0, np.cumsum(np.r_[len(self.strings), self.totals[1:]])[:-1]]  # of each symbol: suffixes that start with less
        seen, carried, fresh = np.zeros(256, np.int64), np.full(256, 255, np.uint8), np.zeros(256, bool)
        where, changed, values = np.empty(len(self.at), np.int64), [], []
        for lo, symbols, prefixes in self._parts({"symbols": "u1", "prefixes": "u1"}):
            m = len(symbols)
            a, b = np.searchsorted(self.at, (lo, lo + m))
            new = np.zeros(m, bool)
            new[self.at[a:b] - lo] = True
            order = np.argsort(symbols, kind="stable")
            n = np.bincount(symbols, minlength=256)
            start = np.cumsum(n) - n
            shift = before + seen - start  # from a place in the order to the number of the suffix that starts with this symbol
            k = np.flatnonzero(new[order])
            where[a + np.searchsorted(self.at[a:b] - lo, order[k])] = k + shift[symbols[order[k]]]
            pair = np.r_[k, k + 1]
            pair = pair[(pair > 0) & (pair < m)]
            mine = symbols[order[pair]]
            same = mine == symbols[order[pair - 1]]
            pair, mine = pair[same], mine[same]
            if len(pair):
                ends = np.stack([order[pair - 1] + 1, order[pair] + 1], axis=1).ravel()
                changed.append(pair + shift[mine])
                values.append(np.minimum.reduceat(np.r_[prefixes, np.uint8(255)], ends)[::2])
            here = np.flatnonzero(n[1:]) + 1
            if len(here):
                head, tail = order[start[here]], order[start[here] + n[here] - 1]
                low = np.minimum(carried[here], _least_to(prefixes, head))
                low = np.where(seen[here] > 0, low, np.uint8(255))  # 255: nothing before it starts with the same symbol
                edge = new[head] | fresh[here]
                changed.append((start + shift)[here][edge])
                values.append(low[edge])
            carried = np.minimum(carried, prefixes.min())
            if len(here):
                carried[here], fresh[here] = _least_to(np.r_[np.uint8(255), prefixes[::-1]], m - 1 - tail), new[tail]
            seen += n
        changed, values = np.concatenate(changed), np.concatenate(values)
        values = np.where(values == 255, 0, np.minimum(values.astype(np.int64) + 1, self.depth)).astype(np.uint8)
        order = np.argsort(changed)
        return where, changed[order], values[order]

    def _round(self, length: int) -> None:
        """Inserts the suffixes of ``length`` bytes."""
        lasting = self.sizes[self.owner] >= length
        self.at, self.owner = self.at[lasting], self.owner[lasting]
        where, changed, values = self._places()
        order = np.argsort(where)
        where, owner = where[order], self.owner[order]
        column = self.width - 1 - length
        symbols = self.strings[owner, column] if column >= 0 else np.zeros(len(owner), np.uint8)
        files = {"symbols": ("u1", symbols), "prefixes": ("u1", np.zeros(len(owner), np.uint8))}
        if length >= self.depth:
            if not self.origins:
                self._path("origins").write_bytes(np.full(self.n, -1, np.int32).tobytes())
                self.origins = True
            files["origins"] = ("i4", (owner * WINDOWS + (self.sizes[owner] - length)).astype(np.int32))
        total = self.n + len(owner)
        opened = []
        try:
            for name, (kind, fresh) in files.items():
                self._path(name, 1).touch()
                opened.append((name, kind, fresh, self._path(name).open("rb"), self._path(name, 1).open("r+b")))
            for lo in range(0, total, self.STEP):
                m = min(self.STEP, total - lo)
                a, b = np.searchsorted(where, (lo, lo + m))
                own, free = where[a:b] - lo, np.ones(m, bool)
                free[own] = False
                for name, kind, fresh, old, out in opened:
                    part = np.empty(m, kind)
                    part[free] = np.fromfile(old, kind, m - (b - a))
                    part[own] = fresh[a:b]
                    if name == "prefixes":
                        c, d = np.searchsorted(changed, (lo, lo + m))
                        part[changed[c:d] - lo] = values[c:d]
                    part.tofile(out)
        finally:
            for *_, old, out in opened:
                old.close()
                out.close()
        self.totals = self.totals + np.bincount(symbols, minlength=256)
        self.n, self.at, self.owner, self.turn = total, where, owner, self.turn + 1

    def earlier(self, ids: np.ndarray) -> np.ndarray:
        """For each string a mask of the windows that also start in a string of a smaller id."""
        masks, kept = np.zeros(len(ids), np.int64), None

        def settle(origin, group):
            own = ids[origin // WINDOWS]
            starts = _runs(group)
            least = np.repeat(np.minimum.reduceat(own, starts), np.diff(np.r_[starts, len(group)]))
            hit = origin[least < own]
            np.add(masks, np.bincount(hit // WINDOWS, weights=np.exp2(hit % WINDOWS), minlength=len(ids)).astype(np.int64), out=masks)

        base = 0
        for _, prefixes, origin in self._parts({"prefixes": "u1", "origins": "i4"}):
            group = base + np.cumsum(prefixes < self.depth)
            base = int(group[-1])
            held = origin >= 0
            origin, group = origin[held], group[held]
            if kept is not None:
                origin, group = np.r_[kept[0], origin], np.r_[kept[1], group]
            done = group < base
            kept = origin[~done], group[~done]
            if done.any():
                settle(origin[done], group[done])
        if kept is not None and len(kept[0]):
            settle(*kept)
        return masks.astype(np.uint32)


def _compared(strings: np.ndarray, sizes: np.ndarray, ids: np.ndarray, depth: int) -> np.ndarray:
    folder = tempfile.mkdtemp(prefix="collection-")
    try:
        return Collection(strings, sizes, depth, folder).earlier(ids)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _may_match(lines: np.ndarray, sizes: np.ndarray, keys: np.ndarray, ids: np.ndarray, params: SuffixParams) -> np.ndarray:
    """Strings that agree with one of their key and of another document in the anchor and half of what a window has beside it.

    A window holds its anchor and ``match - anchor`` bytes on its two sides, so on one of them at least half of those:
    strings that share a window agree there.
    """
    n, width = lines.shape
    half = -(-(params.match - params.anchor) // 2)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(width, _P, np.uint64)])
    inverses = np.cumprod(np.r_[np.uint64(1), np.full(width, _INVERSE, np.uint64)])
    sums = np.zeros((n, width + 1), np.uint64)
    np.cumsum(lines * powers[:width], axis=1, out=sums[:, 1:])
    places = width - params.anchor + 1
    hashes = _mix((sums[:, params.anchor :] - sums[:, :places]) * inverses[:places])
    hashes[np.arange(places) < (width - sizes)[:, None]] = np.uint64(0xFFFFFFFFFFFFFFFF)
    at, rows = hashes.argmin(axis=1), np.arange(n)
    out = np.zeros(n, bool)
    for lo, hi in ((at, at + params.anchor + half), (at - half, at + params.anchor)):
        fits = np.flatnonzero((lo >= width - sizes) & (hi <= width))
        side = _mix((sums[rows[fits], hi[fits]] - sums[rows[fits], lo[fits]]) * inverses[lo[fits]]) ^ keys[fits]
        order = np.lexsort((ids[fits], side))
        starts = _runs(side[order])
        if len(starts):
            own = ids[fits][order]
            several = own[starts] < own[np.r_[starts[1:], len(own)] - 1]
            out[fits[order]] |= np.repeat(several, np.diff(np.r_[starts, len(own)]))
    return out


STRINGS = "part int, places binary, keys binary, bytes binary"


def _fetched(blocks: DataFrame, answers: DataFrame, parts: int, params: SuffixParams) -> DataFrame:
    """(part, places, keys, bytes): the strings that collections compare, dealt by key."""
    asked = answers.filter("asked is not null").groupBy("block").agg(F.collect_list("asked").alias("asked"))

    def strings(block, opened, asked):
        _, _, at, data = opened
        a = _joined([_unpack(x, ASKED) for x in asked], ASKED)
        part = (_mix(a["key"] ^ np.uint64(1)) % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((a["start"], a["row"], part))
        a, part = _taken(a, order), part[order]
        cuts = np.r_[_runs(part), len(part)]
        lo = at[a["row"]] + a["start"]
        hi = lo + a["count"] + params.match - 1
        raw = data.tobytes()
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            own = {k: a[k][x:y] for k in ("id", "row", "start", "count")} | {"block": np.full(y - x, block, np.int64)}
            text = b"".join(raw[i:j] for i, j in zip(lo[x:y].tolist(), hi[x:y].tolist(), strict=True))
            yield int(part[x]), _pack({k: own[k] for k in PLACE}), a["key"][x:y].tobytes(), zstandard.compress(text, 1)

    def run(batches):
        for b in (x.slice(i, 1) for x in batches for i in range(x.num_rows)):
            block, *packed, asked_ = (c[0].as_py() for c in b.columns)
            yield from _batches(strings(block, _opened(*packed), asked_), STRINGS)

    return blocks.join(asked, "block").mapInArrow(run, STRINGS)


def _collected(fetched: DataFrame, parts: int, params: SuffixParams) -> DataFrame:
    """(block, told): windows of the compared strings that go."""
    widest = WINDOWS + params.match - 1

    def lines(places, data, at):
        sizes = places["count"].astype(np.int64) + params.match - 1
        out = np.zeros((len(at), widest), np.uint8)
        column = np.arange(widest)[None, :] - (widest - sizes)[:, None]
        inside = column >= 0
        out[inside] = data[(at[:, None] + column)[inside]] + 1
        return out, sizes

    def bundle(places, data, at):
        masks = _compared(*lines(places, data, at), places["id"], params.match)
        hit = np.flatnonzero(masks)
        p = {k: places[k][hit] for k in ("block", "row", "start")} | {"mask": masks[hit]}
        p = _taken(p, np.lexsort((p["start"], p["row"], p["block"])))
        cuts = np.r_[_runs(p["block"]), len(hit)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(p["block"][a]), _pack({k: p[k][a:b] for k in TOLD}), None

    def run(batches):
        held, keys, texts = [], [], []
        for b in batches:
            for p, k, t in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                held.append(_unpack(p, PLACE))
                keys.append(np.frombuffer(k, np.uint64))
                texts.append(zstandard.decompress(t))
        if not keys:
            return
        places, keys, data = _joined(held, PLACE), np.concatenate(keys), np.frombuffer(b"".join(texts), np.uint8)
        del held, texts
        sizes = places["count"].astype(np.int64) + params.match - 1
        at = np.cumsum(sizes) - sizes
        order = np.argsort(keys, kind="stable")
        places, keys, at = _taken(places, order), keys[order], at[order]
        for step in (True, False):  # first drop what cannot match, then compare the others
            ends, lo, kept = np.r_[_runs(keys)[1:], len(keys)], 0, []
            while lo < len(keys):
                hi = int(ends[max(np.searchsorted(ends, lo + params.collection, "right") - 1, np.searchsorted(ends, lo, "right"))])
                own = _taken(places, slice(lo, hi))
                if step:
                    kept.append(lo + np.flatnonzero(_may_match(*lines(own, data, at[lo:hi]), keys[lo:hi], own["id"], params)))
                else:
                    yield from _batches(bundle(own, data, at[lo:hi]), ANSWERS)
                lo = hi
            if step:
                stays = np.concatenate(kept)
                places, keys, at = _taken(places, stays), keys[stays], at[stays]

    return staged(fetched.repartitionById(parts, "part").mapInArrow(run, ANSWERS), "compared")


# ---- result ----------------------------------------------------------------

RESULT = "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: SuffixParams = SuffixParams()) -> DataFrame:
    """One row for each document: id, n_bytes, spans (removed runs, start and end in bytes), kept (the other bytes)."""
    blocks = _blocks(docs, doc_id, text, params)
    size = blocks.agg(F.sum(F.octet_length("texts"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * size // params.part_bytes))
    dealt = _dealt(blocks, parts, _crowded(blocks, params), params).repartitionById(parts, "part")
    answers = _decided(dealt)
    compared = _collected(_fetched(blocks, answers, parts, params), parts, params)
    told = answers.select("block", "told").unionByName(compared.select("block", "told")).filter("told is not null")
    told = told.groupBy("block").agg(F.collect_list("told").alias("told"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in (x.slice(i, 1) for x in batches for i in range(x.num_rows)):
            _, *packed, told_ = (c[0].as_py() for c in b.columns)
            ids, known, at, data = _opened(*packed)
            t = _joined([_unpack(x, TOLD) for x in told_ or []], TOLD)
            bits = (t["mask"][:, None] >> np.arange(WINDOWS, dtype=np.uint32)) & 1 == 1
            which, offset = np.nonzero(bits)
            start = at[t["row"][which]] + t["start"][which] + offset
            depth = np.bincount(start, minlength=len(data) + params.match + 1) - np.bincount(start + params.match, minlength=len(data) + params.match + 1)
            gone = np.cumsum(depth)[: len(data)] > 0
            edges = np.diff(np.r_[False, gone, False].astype(np.int8))
            owner = np.repeat(np.arange(len(ids)), np.diff(at))
            split = np.zeros(len(data) + 1, bool)  # a run that reaches the next document ends there
            split[at] = True
            inner = np.flatnonzero(split[:-1] & gone & np.r_[False, gone[:-1]])
            first, last = np.sort(np.r_[np.flatnonzero(edges == 1), inner]), np.sort(np.r_[np.flatnonzero(edges == -1), inner])
            per = np.bincount(owner[first], minlength=len(ids)) if len(first) else np.zeros(len(ids), np.int64)
            base = at[owner[first]] if len(first) else np.empty(0, np.int64)
            spans = pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(per)], pa.int32()), pa.StructArray.from_arrays([pa.array(first - base), pa.array(last - base)], ["start", "end"])
            )
            left = np.bincount(owner[~gone], minlength=len(ids)) if len(data) else np.zeros(len(ids), np.int64)
            ends = np.r_[0, np.cumsum(left)].tolist()
            kept = data[~gone].tobytes()
            for lo in range(0, len(ids), 500):
                hi = min(lo + 500, len(ids))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[lo:hi], mask=~known[lo:hi]), pa.array(np.diff(at)[lo:hi]), spans.slice(lo, hi - lo).cast(kind),
                        pa.array([kept[ends[i] : ends[i + 1]] for i in range(lo, hi)], pa.binary()),
                    ],
                    ["id", "n_bytes", "spans", "kept"],
                )

    return blocks.join(told, "block", "left").mapInArrow(run, RESULT)
