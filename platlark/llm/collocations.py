"""Phrase collocations: exact counts of frequent phrases by minimal perfect hashing, scored by their weakest cut.

Texts are cut into words once, into chunks of word numbers that are staged.  Words are
counted; those seen often enough get an id.  Then lengths 2 to 5 are taken in turn.  A
phrase of L words is a pair of ids, that of its first L - 1 words and that of its last
word, so its key is an exact 64-bit number.  It can be frequent only if the phrases
without its last and without its first word are (Apriori), and only if the bucket that
its key hashes to is full enough; neither test loses a frequent phrase.

Words are counted in two steps as well: by bucket first, then only those in full buckets.

1. mappers count keys by bucket in one array (each mapper's counts are cut at the
   threshold, which keeps the test safe); the arrays are summed in blocks, each block
   where its number's hash deals it.  There are ``2 ** least_bits`` buckets, and about one for each
   ``bucket_words`` words of a larger corpus.
2. the distinct keys that pass both tests are the candidates.
3. a minimal perfect hash over them goes to the mappers, which ``bincount`` verified
   slots; a key that is not the one stored at its slot is no candidate.
4. the sums that reach the threshold are the frequent phrases.  A hash over those
   numbers every position's phrase for the next length.

A phrase's cuts are read by slot: with its count, each frequent phrase inherits the
counts of its heads from the phrase without the last word and those of its tails from the
phrase without the first.

A hash holds at most about a million keys (``slice_keys``).  More keys are dealt into
slices, and the mappers take one slice after the other; so are buckets beyond ``2 **
bucket_bits``.  What is broadcast has a fixed size whatever the corpus: one slice of a
hash, or the bits of one slice of buckets.

Defined results
* null and empty texts have no words; a null ``lang`` is ``und``; ids and other columns
  take no part, so repeated rows count as often as they stand there.
* of equal scores the more frequent phrase comes first, then the smaller one by bytes.
* an empty table, or one without a frequent phrase, gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from platlark.functions.shared import staged

#: Places in a block of an array that is summed.
BLOCK = 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?" or 10 <= c <= 13 else c for c in range(256))
#: Bytes of a text that are cut into words at once, where it has an end of a piece.
STRETCH = 1 << 20


@dataclass(frozen=True)
class PhraseParams:
    """``contained_percent``: a phrase goes if a longer one around it is at least so frequent, in per cent."""

    min_count: int = 100
    longest: int = 5
    top: int = 2000
    contained_percent: int = 100
    bucket_words: int = 32
    bucket_bits: int = 24
    least_bits: int = 22
    slice_keys: int = 900_000
    chunk_words: int = 250_000


# ---- minimal perfect hash --------------------------------------------------


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Numbers ``n`` distinct 64-bit keys from 0 to n - 1.

    A level is a row of bits; a key that is alone at its bit is settled there, all others go to the
    next level.  A key's number is the count of set bits before its own.
    """

    def __init__(self, keys: np.ndarray):
        self.n, self.bits, self.before, base, seed = len(keys), [], [], 0, 0
        while len(keys):
            words = max(1, len(keys) // 32)
            at = _mix(keys, seed) % np.uint64(words * 64)
            alone = np.bincount(at.astype(np.int64), minlength=words * 64) == 1
            level = np.packbits(alone, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(level).astype(np.int64)
            self.bits.append(level)
            self.before.append(base + np.cumsum(ones) - ones)
            base += int(ones.sum())
            keys, seed = keys[~alone[at.astype(np.int64)]], seed + 1
            if seed > 200:
                raise ValueError("the keys are not distinct")

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number; for other keys any number, or -1."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for seed, (level, before) in enumerate(zip(self.bits, self.before, strict=True)):
            if not len(open_):
                break
            at = _mix(keys[open_], seed) % np.uint64(len(level) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            w = level[word]
            hit = (w >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(w & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = (before[word] + below)[hit]
            open_ = open_[~hit]
        return out


class KeyIndex:
    """Verified numbers of one slice's keys: -1 for a key that is not among them."""

    def __init__(self, keys: np.ndarray, base: int):
        self.base, self.hash = base, PerfectHash(keys)
        self.stored = np.empty(len(keys), np.uint64)
        self.stored[self.hash.slots(keys)] = keys

    def ids(self, keys: np.ndarray) -> np.ndarray:
        slots = self.hash.slots(keys)
        if not len(self.stored):
            return slots
        return np.where((slots >= 0) & (self.stored[slots] == keys), slots + self.base, -1)


class WordIndex:
    """The same for words, verified letter by letter."""

    def __init__(self, names: list[bytes], base: int):
        self.base, self.seed = base, 0
        while len(np.unique(keys := self.keys(names))) < len(names):
            self.seed += 1
        self.hash = PerfectHash(keys)
        self.stored: list[bytes] = [b""] * len(names)
        for slot, name in zip(self.hash.slots(keys).tolist(), names, strict=True):
            self.stored[slot] = name

    def keys(self, names: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(x, self.seed) for x in names), np.uint64, len(names))

    def ids(self, names: list[bytes]) -> np.ndarray:
        slots = self.hash.slots(self.keys(names)).tolist()
        return np.fromiter((s + self.base if s >= 0 and self.stored[s] == x else -1 for s, x in zip(slots, names, strict=True)), np.int64, len(names))


# ---- sums of arrays --------------------------------------------------------


def _packed(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def _unpacked(b, dtype=np.int32) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype)


def _blocks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(block, cells) of every block that is not empty."""
    wide = np.pad(counts, (0, -len(counts) % BLOCK if len(counts) else BLOCK)).reshape(-1, BLOCK)
    held = np.flatnonzero(wide.any(axis=1))
    for part in (held[i : i + 256] for i in range(0, len(held), 256)):
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([_cells(wide[b]) for b in part], pa.binary())], ["block", "cells"])


BLOCKS = "block int, cells binary"


def _cells(a: np.ndarray) -> bytes:
    """Counts in the narrowest type, its size first."""
    kind = np.min_scalar_type(int(a.max()))
    return bytes([kind.itemsize]) + _packed(a.astype(kind))


def _counts(cells: bytes) -> np.ndarray:
    return _unpacked(cells[1:], f"u{cells[0]}").astype(np.int64)


def _block_sums(parts: DataFrame, name: str) -> DataFrame:
    """Arrays of equal blocks added up.  Blocks are dealt over all tasks, so no task holds more than its own."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, cells in zip(*(c.to_pylist() for c in b.columns), strict=True):
                a = _counts(cells)
                sums[block] = sums[block] + a if block in sums else a
        for block, a in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_cells(a)], pa.binary())], ["block", "cells"])

    return staged(parts.repartition("block").mapInArrow(add, BLOCKS), name)


def _sums(blocks: DataFrame, least: int) -> DataFrame:
    """(slot, f) of the cells that reach ``least``."""

    def run(batches):
        for b in batches:
            for block, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = _counts(cells)
                at = np.flatnonzero(a >= least)
                yield pa.RecordBatch.from_arrays([pa.array(at + block * BLOCK), pa.array(a[at])], ["slot", "f"])

    return blocks.select("block", "cells").mapInArrow(run, "slot long, f long")


def _full_bits(sums: DataFrame, bits: int, least: int) -> np.ndarray:
    """Which of ``2 ** bits`` summed cells reach ``least``, as packed bits."""

    def packed(batches):
        for b in batches:
            full = [np.packbits(_counts(c) >= least, bitorder="little").tobytes() for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(full, pa.binary())], ["block", "full"])

    out = np.zeros((max(1, (1 << bits) // BLOCK), BLOCK // 8), np.uint8)
    for block, full in zip(*(c.to_pylist() for c in sums.mapInArrow(packed, "block int, full binary").toArrow().columns), strict=True):
        out[block] = np.frombuffer(full, np.uint8)
    return out.reshape(-1)


# ---- words -----------------------------------------------------------------


def _stretches(text: bytes) -> Iterator[bytes]:
    """A lower-cased text, its pieces ended by points, in parts that end with a piece."""
    at = 0
    while len(text) - at > STRETCH:
        end = text.rfind(b".", at, at + STRETCH) + 1 or text.find(b".", at + STRETCH) + 1
        if not end:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def _chunks(docs: DataFrame, text: str, lang: str, params: PhraseParams) -> DataFrame:
    """(lang, names, at): distinct words of a chunk, one a line, and the number of each position's word; pieces end in ``.``."""

    def run(batches):
        held: dict[str, list[bytes]] = defaultdict(list)

        def chunk(tag):
            numbers = defaultdict(count().__next__)
            at = np.fromiter(map(numbers.__getitem__, held[tag]), np.int32, len(held[tag]))
            return pa.RecordBatch.from_arrays(
                [pa.array([tag]), pa.array([zstandard.compress(b"\n".join(numbers), 1)], pa.binary()), pa.array([_packed(at)], pa.binary())], ["lang", "names", "at"]
            )

        n = 0
        for b in (x.slice(i, 200) for x in batches for i in range(0, x.num_rows, 200)):
            for tag, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for part in _stretches((t or b"").translate(_LOWER)):
                    own = part.replace(b".", b" . ").split()
                    held[tag] += own
                    held[tag].append(b".")
                    n += len(own) + 1
                    if len(held[tag]) >= params.chunk_words:
                        n -= len(held[tag])
                        yield chunk(tag)
                        del held[tag]
            if n >= 4 * params.chunk_words:
                for tag in list(held):
                    yield chunk(tag)
                held.clear()
                n = 0
        for tag in list(held):
            yield chunk(tag)

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")), F.col(text).cast("string").cast("binary"))
    return staged(rows.mapInArrow(run, "lang string, names binary, at binary"), "chunks", "none")


#: Words that a task holds before it hands them on.
HELD_WORDS = 400_000


def _word_keys(tag: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(tag.encode(), 7)
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _full_words(chunks: DataFrame, params: PhraseParams) -> np.ndarray:
    """Whether each of ``2 ** least_bits`` buckets of words may hold a frequent one, as packed bits."""
    least, kind = params.min_count, np.min_scalar_type(2 * params.min_count)

    def run(batches):
        counts = np.zeros(1 << params.least_bits, kind)
        for b in batches:
            for tag, names, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = zstandard.decompress(names).split(b"\n")
                place = (_word_keys(tag, words) >> np.uint64(64 - params.least_bits)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                place, n = place[order], np.bincount(_unpacked(at), minlength=len(words))[order]
                first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                own = np.minimum(np.add.reduceat(n, first), least).astype(kind)
                counts[place[first]] = np.minimum(counts[place[first]] + own, least)
        yield from _blocks(counts)

    return _full_bits(_block_sums(chunks.mapInArrow(run, BLOCKS), "wordbuckets"), params.least_bits, least)


def _word_counts(chunks: DataFrame, params: PhraseParams) -> DataFrame:
    """(lang, word, f): the frequent words, and a row without a word for all words of a language.

    A task adds up its own words in full buckets and packs them, in order, for the part that a word's hash names.
    """
    sent = chunks.sparkSession.sparkContext.broadcast(_full_words(chunks, params))
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        held: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))
        whole: dict[str, int] = defaultdict(int)

        def packed():
            for tag, counts in held.items():
                words = sorted(counts)
                part = np.fromiter((xxhash.xxh3_64_intdigest(w, 5) % parts for w in words), np.int32, len(words))
                f = np.fromiter((counts[w] for w in words), np.int64, len(words))
                for k in np.unique(part):
                    at = np.flatnonzero(part == k)
                    text = zstandard.compress(b"\n".join([words[i] for i in at]), 3)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([tag]), pa.array([text], pa.binary()), pa.array([_packed(f[at])], pa.binary())], ["part", "lang", "words", "f"])
            held.clear()

        for b in batches:
            for tag, names, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = zstandard.decompress(names).split(b"\n")
                own, f = held[tag], np.bincount(_unpacked(at), minlength=len(words))
                place = (_word_keys(tag, words) >> np.uint64(64 - params.least_bits)).astype(np.int64)
                full = np.flatnonzero((sent.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                for i, n in zip(full.tolist(), f[full].tolist(), strict=True):
                    if words[i] != b".":
                        own[words[i]] += n
                whole[tag] += int(f.sum()) - int(f[words.index(b".")] if b"." in words else 0)
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield from packed()
        yield from packed()
        for tag, n in whole.items():
            part = xxhash.xxh3_64_intdigest(tag.encode(), 5) % parts
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([tag]), pa.array([None], pa.binary()), pa.array([_packed(np.array([n], np.int64))], pa.binary())], ["part", "lang", "words", "f"])

    def meet(batches):
        held: dict[str, dict[bytes | None, int]] = defaultdict(lambda: defaultdict(int))
        for b in batches:
            for tag, words, f in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                own = held[tag]
                for w, n in zip([None] if words is None else zstandard.decompress(words).split(b"\n"), _unpacked(f, np.int64).tolist(), strict=True):
                    own[w] += n
        for tag, counts in held.items():
            rows = [(w, n) for w, n in counts.items() if w is None or n >= params.min_count]
            yield pa.RecordBatch.from_arrays(
                [pa.array([tag] * len(rows), pa.string()), pa.array([None if w is None else w.decode() for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["lang", "word", "f"]
            )

    return chunks.mapInArrow(run, "part int, lang string, words binary, f binary").repartitionById(parts, "part").mapInArrow(meet, "lang string, word string, f long")


# ---- levels ----------------------------------------------------------------


def _slices(keys: DataFrame, key: str, params: PhraseParams) -> tuple[DataFrame, int]:
    """``keys`` with the slice of each, and the number of slices."""
    n = max(1, -(-keys.count() // params.slice_keys))
    return keys.withColumn("slice", F.pmod(F.xxhash64(key), F.lit(n))), n


def _indexed(rows: DataFrame, name: str, key: str, params: PhraseParams, index, ids):
    """Yields, slice by slice, a broadcast index, the slice's rows with their ``id``, how many, and whether it is the last."""
    rows, n = _slices(rows, key, params)
    sc, base = rows.sparkSession.sparkContext, 0
    fields = ", ".join(f"{c} {t}" for c, t in rows.drop("slice").dtypes)
    for s in range(n):
        own = rows.filter(F.col("slice") == s).drop("slice")
        built = index(own.select(key).toArrow().column(0), base)
        sent = sc.broadcast(built)

        def numbered(batches, sent=sent, at=own.columns.index(key)):
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids(sent.value, b.column(at)))], [*b.schema.names, "id"])

        yield sent, staged(own.mapInArrow(numbered, f"{fields}, id long"), name), built.hash.n, s == n - 1
        base += built.hash.n
        sent.unpersist()


def _all_slices(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _keys_at(w: np.ndarray, p: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a phrase of ``length`` words may be frequent, and its key there."""
    m = len(w) - length + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero((p[:m] >= 0) & (p[1 : m + 1] >= 0))
    return at, (p[at].astype(np.uint64) << np.uint64(32)) | w[at + length - 1].astype(np.uint64)


def _word_level(chunks: DataFrame, words: DataFrame, params: PhraseParams) -> tuple[DataFrame, DataFrame]:
    """Frequent words with ids, and (w, p): each chunk's word ids, -1 for rare words and ends of pieces; p is equal to w."""
    key = F.concat_ws("\n", "lang", "word")
    rows = words.filter("word is not null").select("lang", "word", "f", key.alias("key"))
    name = lambda c: [x.encode() for x in c.to_pylist()]
    table, level = chunks.withColumn("w", F.lit(None).cast("binary")), []
    for sent, part, _, last in _indexed(rows, "words", "key", params, lambda c, base: WordIndex(name(c), base), lambda i, c: i.ids(name(c))):
        level.append(part)

        def number(batches, sent=sent, last=last):
            for b in batches:
                for tag, names, at, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    own = sent.value.ids([tag.encode() + b"\n" + x for x in zstandard.decompress(names).split(b"\n")])
                    w_new = own[_unpacked(at)].astype(np.int32)
                    w_new = w_new if w is None else np.maximum(_unpacked(w), w_new)
                    cols = {"lang": pa.array([tag]), "names": pa.array([names], pa.binary()), "at": pa.array([at], pa.binary()), "w": pa.array([_packed(w_new)], pa.binary())}
                    yield pa.RecordBatch.from_pydict({"w": cols["w"]} if last else cols)

        table = staged(table.mapInArrow(number, "w binary" if last else "lang string, names binary, at binary, w binary"), "wordids", "none")
    return _all_slices(level), table.select("w", F.col("w").alias("p"))


@dataclass(frozen=True)
class _Buckets:
    """``slices`` times ``2 ** bits`` buckets of keys."""

    bits: int
    slices: int

    @classmethod
    def of(cls, n_words: int, params: PhraseParams) -> _Buckets:
        bits = max(params.least_bits, (n_words // params.bucket_words).bit_length())
        return cls(min(bits, params.bucket_bits), 1 << max(0, bits - params.bucket_bits))

    def own(self, keys: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        """Which keys belong to a slice, and their buckets there."""
        h = _mix(keys, 77)
        at = np.flatnonzero(h & np.uint64(self.slices - 1) == part) if self.slices > 1 else np.arange(len(keys))
        return at, (h[at] >> np.uint64(64 - self.bits)).astype(np.int64)


def _full_buckets(table: DataFrame, length: int, buckets: _Buckets, part: int, params: PhraseParams) -> np.ndarray:
    """Whether each bucket of a slice may hold a frequent phrase, as packed bits."""
    least, kind = params.min_count, np.min_scalar_type(2 * params.min_count)

    def run(batches):
        counts = np.zeros(1 << buckets.bits, kind)
        for b in batches:
            for w, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, keys = _keys_at(_unpacked(w), _unpacked(p), length)
                place, n = np.unique(buckets.own(keys, part)[1], return_counts=True)
                counts[place] = np.minimum(counts[place] + np.minimum(n, least).astype(kind), least)
        yield from _blocks(counts)

    return _full_bits(_block_sums(table.mapInArrow(run, BLOCKS), "buckets"), buckets.bits, least)


#: Keys that a task holds before it hands them on.
HELD = 1_000_000


def _distinct(keys: list[np.ndarray], sids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    own, first = np.unique(np.concatenate(keys), return_index=True)
    return own, np.concatenate(sids)[first]


def _key_parts(keys: np.ndarray, sids: np.ndarray, parts: int) -> pa.RecordBatch:
    """(part, n, keys): distinct keys in order with their ids, packed for the part that a key's hash names."""
    part = (_mix(keys, 78) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    held = [(k, order[a:b]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    packed = [zstandard.compress(np.diff(keys[at], prepend=np.uint64(0)).tobytes() + sids[at].astype(np.int32).tobytes(), 1) for _, at in held]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int32()), pa.array([len(at) for _, at in held], pa.int32()), pa.array(packed, pa.binary())], ["part", "n", "keys"])


def _candidates(table: DataFrame, length: int, buckets: _Buckets, params: PhraseParams) -> DataFrame:
    """(key, sid): distinct keys in full buckets, with the id of the phrase without its first word.

    A task tells its keys apart before it hands them on.
    """
    spark, found = table.sparkSession, []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for part in range(buckets.slices):
        sent = spark.sparkContext.broadcast(_full_buckets(table, length, buckets, part, params))

        def run(batches, sent=sent, part=part):
            keys, sids, n = [], [], 0
            for b in batches:
                for w, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    p = _unpacked(p)
                    at, own = _keys_at(_unpacked(w), p, length)
                    held, place = buckets.own(own, part)
                    held = held[(sent.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
                    keys.append(own[held])
                    sids.append(p[at[held] + 1])
                    n += len(held)
                    if n > 2 * HELD:
                        k, s = _distinct(keys, sids)
                        keys, sids, n = [k], [s], len(k)
                        if n > HELD:
                            yield _key_parts(k, s, parts)
                            keys, sids, n = [], [], 0
            if n:
                yield _key_parts(*_distinct(keys, sids), parts)

        def meet(batches):
            keys, sids = [], []
            for b in batches:
                for n, packed in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    raw = zstandard.decompress(packed)
                    keys.append(np.cumsum(np.frombuffer(raw, np.uint64, n), dtype=np.uint64))
                    sids.append(np.frombuffer(raw, np.int32, n, 8 * n))
                    if len(keys) > 64:
                        keys, sids = ([x] for x in _distinct(keys, sids))
            if keys:
                k, s = _distinct(keys, sids)
                for i in range(0, len(k), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 100_000].view(np.int64)), pa.array(s[i : i + 100_000].astype(np.int64))], ["key", "sid"])

        dealt = table.mapInArrow(run, "part int, n int, keys binary").repartitionById(parts, "part")
        found.append(staged(dealt.mapInArrow(meet, "key long, sid long"), "keys"))
        sent.unpersist()
    return _all_slices(found)


def _key_index(c, base):
    return KeyIndex(c.to_numpy().astype(np.int64).view(np.uint64), base)


def _key_ids(index, c):
    return index.ids(c.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def _count(table: DataFrame, length: int, candidates: DataFrame, params: PhraseParams) -> DataFrame:
    """(key, sid, f) of the candidates that reach the threshold: slots are counted in arrays."""
    found = []
    for sent, part, n, _ in _indexed(candidates, "candidates", "key", params, _key_index, _key_ids):

        def run(batches, sent=sent, n=n):
            index = sent.value
            counts = np.zeros(n, np.int64)
            for b in batches:
                for w, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    _, keys = _keys_at(_unpacked(w), _unpacked(p), length)
                    ids = index.ids(keys)
                    counts += np.bincount(ids[ids >= 0] - index.base, minlength=n)
            yield from _blocks(counts)

        sums = _sums(_block_sums(table.mapInArrow(run, BLOCKS), "counts"), params.min_count)
        slot = (F.col("id") - F.lit(sent.value.base)).alias("slot")
        found.append(staged(part.select("key", "sid", slot).join(sums, "slot").select("key", "sid", "f"), "frequent"))
    return _all_slices(found)


def _number(table: DataFrame, length: int, frequent: DataFrame, params: PhraseParams, longest: bool) -> tuple[DataFrame, DataFrame]:
    """The frequent phrases with ids, and the table with each position's phrase of ``length`` words as ``p``."""
    table, level = table.withColumn("q", F.lit(None).cast("binary")), []
    for sent, part, _, last in _indexed(frequent, "phrases", "key", params, _key_index, _key_ids):
        level.append(part)
        if longest:
            continue

        def number(batches, sent=sent, last=last):
            for b in batches:
                for w, p, q in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    words = _unpacked(w)
                    at, keys = _keys_at(words, _unpacked(p), length)
                    new = np.full(len(words), -1, np.int32)
                    new[at] = sent.value.ids(keys)
                    new = new if q is None else np.maximum(_unpacked(q), new)
                    cols = {"w": w, "q": _packed(new)} if last else {"w": w, "p": p, "q": _packed(new)}
                    yield pa.RecordBatch.from_pydict({k: pa.array([x], pa.binary()) for k, x in cols.items()})

        table = staged(table.mapInArrow(number, "w binary, q binary" if last else "w binary, p binary, q binary"), "phraseids", "none")
    return _all_slices(level), table if longest else table.select("w", F.col("q").alias("p"))


# ---- scores ----------------------------------------------------------------


def _scored(rows: DataFrame) -> DataFrame:
    """Adds l, r and score of the lowest cut, in whole numbers of any size."""

    def run(batches):
        for b in batches:
            out = []
            for a, n, lefts, rights in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                score, k = min((1000 * a * n // (x * y), k) for k, (x, y) in enumerate(zip(lefts, rights, strict=True)))
                out.append((lefts[k], rights[k], score))
            cols = [pa.array([o[i] for o in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *cols], ["lang", "phrase", "a", "n", "l", "r", "score"])

    own = rows.select("lang", "phrase", F.col("f").alias("a"), "n", "lefts", "rights")
    return own.mapInArrow(run, "lang string, phrase string, a long, n long, l long, r long, score long")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", params: PhraseParams = PhraseParams()) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score."""
    chunks = _chunks(docs, text, lang, params)
    words = staged(_word_counts(chunks, params), "wordcounts")
    totals = words.filter("word is null").select("lang", F.col("f").alias("n"))
    buckets = _Buckets.of(totals.agg(F.sum("n")).first()[0] or 0, params)
    level, table = _word_level(chunks, words, params)
    none = F.array().cast("array<bigint>")
    info = level.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("lefts"), none.alias("rights"))
    infos = []
    for length in range(2, params.longest + 1):
        frequent = _count(table, length, _candidates(table, length, buckets, params), params)
        level, table = _number(table, length, frequent, params, length == params.longest)
        level = level.select("id", "f", "sid", F.shiftright("key", 32).alias("pid"))
        head = info.select(F.col("id").alias("pid"), "lang", "phrase", F.col("f").alias("hf"), "lefts")
        tail = info.select(F.col("id").alias("sid"), "last", F.col("f").alias("tf"), "rights")
        info = level.join(head, "pid").join(tail, "sid").select(
            "id", "pid", "sid", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f",
            F.concat("lefts", F.array("hf")).alias("lefts"), F.concat(F.array("tf"), "rights").alias("rights"),
        )
        info = staged(info, "level")
        infos.append(info)
        if not info.head(1):
            break
    kept = []
    for shorter, longer in zip(infos, [*infos[1:], None], strict=True):
        own = shorter.withColumn("around", F.lit(0).cast("long"))
        if longer is not None:
            parts = longer.select(F.col("pid").alias("id"), "f").unionByName(longer.select(F.col("sid").alias("id"), "f"))
            own = shorter.join(parts.groupBy("id").agg(F.max("f").alias("around")), "id", "left")
        kept.append(own.filter(F.coalesce("around", F.lit(0)) * 100 < F.col("f") * params.contained_percent).select("lang", "phrase", "f", "lefts", "rights"))
    scored = _scored(_all_slices(kept).join(totals, "lang"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= params.top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
