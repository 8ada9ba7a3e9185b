"""Training-order materialisation: a keyed permutation gives every sequence its slot on disk.

Token ids of whole documents, each ended by one end id, are joined and cut into
sequences of ``length`` ids; the last of a scan task is padded with the end id.
Sequences are staged once, which fixes their numbers 0..N-1.  A balanced Feistel
network over the smallest even number of bits that holds N, walked along its cycle
until it falls below N, is a permutation of 0..N-1: the slot of each sequence, found
without any global sort or table.  Slots are dealt out by ranges, whose bounds follow
from N, and each range writes shards of ``per_shard`` records of one fixed stride (two
bytes an id), so slot s is in shard s // per_shard at byte (s % per_shard) * stride,
and a reader can start anywhere.  Sequences of one shard that a task meets close
together travel as one compressed bundle.

A shard is one value of Spark's text writer, so its file ends in one newline byte
after the last record.

Defined results
* null text is the empty text: its end id alone.
* rows repeated under one id are tokenised as often as they occur; null ids are
  left out of ``doc_ids`` but their tokens are kept.
* a tokenizer that gives an id of more than two bytes raises an error.
* very long texts span sequences; extra columns are ignored; an empty table gives no
  sequences and an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from platlark.functions.shared import fresh_path, staged
from platlark.llm import tokens


@dataclass(frozen=True)
class OrderParams:
    length: int = 2048
    end_id: int = 0
    per_shard: int = 4096
    bundle: int = 2000
    key: int = 0x5EED
    rounds: int = 6

    @property
    def stride(self) -> int:
        return 2 * self.length


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser over the half block and the round key."""
    x = x + np.uint64((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """Slots of ``index`` in 0..n-1: a permutation for every key."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    low, bits = np.uint64((1 << half) - 1), np.uint64(half)

    def once(x):
        left, right = x >> bits, x & low
        for r in range(rounds):
            left, right = right, left ^ (_mix(right, key * 131 + r + 1) & low)
        return (left << bits) | right

    out = once(np.asarray(index, dtype=np.uint64))
    while len(walk := np.flatnonzero(out >= n)):
        out[walk] = once(out[walk])
    return out.astype(np.int64)


def two_bytes(ids: np.ndarray) -> np.ndarray:
    if ids.max() > 0xFFFF:
        raise ValueError(f"id {ids.max()} does not fit into two bytes")
    return ids


def sequences(docs: DataFrame, doc_id: str, text: str, tokenizer: str, params: OrderParams) -> DataFrame:
    """(task, local, n_tokens, doc_ids, ids_crc32, data): the sequences of each scan task, numbered from 0."""
    kind = docs.schema[doc_id].dataType.simpleString()
    size = params.length
    schema = f"task int, local long, n_tokens int, doc_ids array<{kind}>, ids_crc32 long, data binary"

    def run(batches):
        encode = tokens.encoder(tokenizer).encode
        task = TaskContext.get().partitionId()
        held, owners, count, local = [], [], 0, 0

        def cut(ids: np.ndarray, spans, n):
            nonlocal local
            data = ids.astype("<u2").tobytes()
            row = (task, local, n, [o for o in dict.fromkeys(spans) if o is not None], zlib.crc32(data), data)
            local += 1
            return row

        def batch(rows):
            types = [pa.int32(), pa.int64(), pa.int32(), pa.list_(id_type), pa.int64(), pa.binary()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(cols, ["task", "local", "n_tokens", "doc_ids", "ids_crc32", "data"])

        id_type = pa.int64()
        for b in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
            id_type, rows = b.column(0).type, []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = two_bytes(np.append(np.frombuffer(encode(t), dtype="<u4"), np.uint32(params.end_id)))
                held.append(ids)
                owners.append((i, len(ids)))
                count += len(ids)
                if count >= size:
                    flat, spans, at = np.concatenate(held), [], 0
                    ends = np.cumsum([n for _, n in owners])
                    while count - at >= size:
                        a, z = np.searchsorted(ends, [at, at + size - 1], side="right")
                        spans = [o for o, _ in owners[a : z + 1]]
                        rows.append(cut(flat[at : at + size], spans, size))
                        at += size
                    a = int(np.searchsorted(ends, at, side="right"))
                    owners = [(o, int(e - max(at, e - n))) for (o, n), e in zip(owners[a:], ends[a:], strict=True)]
                    held, count = ([flat[at:]], count - at) if count > at else ([], 0)
            if rows:
                yield batch(rows)
        if count:
            flat = np.concatenate([*held, np.full(size - count, params.end_id, dtype=np.uint32)])
            yield batch([cut(flat, [o for o, _ in owners], count)])

    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).mapInArrow(run, schema)


def first_numbers(seqs: DataFrame) -> tuple[dict[int, int], int]:
    """The number of each scan task's first sequence; how many sequences there are."""
    counts = dict(seqs.groupBy("task").count().collect())  # one row for each scan task
    first, total = {}, 0
    for task in sorted(counts):
        first[task], total = total, total + counts[task]
    return first, total


def _places(b: pa.RecordBatch, first: dict[int, int], total: int, params: OrderParams) -> tuple[np.ndarray, np.ndarray]:
    """(sequence_id, slot) of the rows of a batch."""
    task, local = b.column("task").to_numpy(), b.column("local").to_numpy()
    index = local + np.array([first[t] for t in task.tolist()], dtype=np.int64)
    return index, permute(index, total, params.key, params.rounds)


def numbered(seqs: DataFrame, first: dict[int, int], total: int, params: OrderParams) -> DataFrame:
    """``seqs`` with sequence_id, slot and shard."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seqs.schema.fields)

    def run(batches):
        for b in batches:
            index, slot = _places(b, first, total, params)
            t = pa.Table.from_batches([b]).append_column("sequence_id", pa.array(index)).append_column("slot", pa.array(slot))
            yield from t.append_column("shard", pa.array(slot // params.per_shard)).combine_chunks().to_batches()

    return seqs.mapInArrow(run, f"{fields}, sequence_id long, slot long, shard long")


def write_shards(seqs: DataFrame, first: dict[int, int], total: int, path: str, params: OrderParams) -> None:
    """Fixed-stride shard files under ``path``/shard=K/."""
    shards = -(-total // params.per_shard)
    n = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def bundles(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in (x.slice(i, params.bundle) for x in batches for i in range(0, x.num_rows, params.bundle)):
            slot = _places(b, first, total, params)[1]
            data = b.column("data")
            order = np.argsort(slot)
            shard = slot[order] // params.per_shard
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(order)]
            runs = [order[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)] if len(order) else []
            at = [slot[r].tobytes() for r in runs]
            z = [pack(b"".join(data.take(pa.array(r)).to_pylist())) for r in runs]
            own = [int(slot[r[0]]) // params.per_shard for r in runs]
            part = [k * n // shards for k in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(own, pa.int64()), pa.array(at, pa.binary()), pa.array(z, pa.binary())], ["part", "shard", "slots", "z"]
            )

    def files(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        held, at = bytearray(), None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([bytes(held)], pa.binary()), pa.array([at], pa.int64())], ["value", "shard"])

        for b in batches:
            for shard, slots, z in zip(*(b.column(k).to_pylist() for k in ("shard", "slots", "z")), strict=True):
                if shard != at:
                    if at is not None:
                        yield done()
                    at = shard
                    held = bytearray(params.stride * min(params.per_shard, total - shard * params.per_shard))
                data = memoryview(unpack(z))
                for k, slot in enumerate((np.frombuffer(slots, np.int64) - shard * params.per_shard).tolist()):
                    held[slot * params.stride : (slot + 1) * params.stride] = data[k * params.stride : (k + 1) * params.stride]
        if at is not None:
            yield done()

    bundled = seqs.select("task", "local", "data").mapInArrow(bundles, "part int, shard long, slots binary, z binary")
    dealt = bundled.repartitionById(n, "part").drop("part").sortWithinPartitions("shard")
    out = dealt.mapInArrow(files, "value binary, shard long").select(F.col("value").cast("string"), "shard")
    out.write.partitionBy("shard").text(path)


def read_shards(spark: SparkSession, path: str, params: OrderParams, start_slot: int = 0) -> DataFrame:
    """(slot, shard, byte_offset, ids) from ``start_slot`` on; folders of earlier shards are left out when the scan is planned."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("shard") >= start_slot // params.per_shard).filter("length > 1")
    files = files.withColumn("shard", F.col("shard").cast("long"))

    def run(batches):
        for b in batches:
            for shard, content in zip(b.column(0), b.column(1), strict=True):
                data, k = content.as_py(), shard.as_py()
                n = len(data) // params.stride
                at = np.arange(n) * params.stride
                slot = k * params.per_shard + np.arange(n)
                keep = np.flatnonzero(slot >= start_slot)
                ids = [data[at[i] : at[i] + params.stride] for i in keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot[keep]), pa.array(np.full(len(keep), k)), pa.array(at[keep]), pa.array(ids, pa.binary())],
                    ["slot", "shard", "byte_offset", "ids"],
                )

    return files.select("shard", "content").mapInArrow(run, "slot long, shard long, byte_offset long, ids binary")


def materialise(
    docs: DataFrame, path: str, doc_id="doc_id", text="text", tokenizer: str | None = None, params: OrderParams = OrderParams()
) -> DataFrame:
    """Writes the shards under ``path``; returns one row per sequence, without its ids."""
    seqs = staged(sequences(docs, doc_id, text, tokenizer or tokens.default_path(), params), "sequences", "zstd")
    first, total = first_numbers(seqs)
    write_shards(seqs, first, total, path, params)
    return numbered(seqs.drop("data"), first, total, params).select("sequence_id", "slot", "shard", "n_tokens", "doc_ids", "ids_crc32")


def round_trip(docs: DataFrame, doc_id="doc_id", text="text", tokenizer=None, params: OrderParams = OrderParams()) -> DataFrame:
    """Every sequence's slot and place in the shards; checksums are of the ids read back from there."""
    spark = docs.sparkSession
    path = fresh_path(spark, "shards")
    index = materialise(docs, path, doc_id, text, tokenizer, params)
    if not index.head(1):
        return index.select("sequence_id", "slot", "shard", F.lit(0).cast("long").alias("byte_offset"), "n_tokens", "ids_crc32", "doc_ids")
    back = read_shards(spark, path, params).select(
        F.col("slot").alias("at"), "byte_offset", F.crc32("ids").alias("crc")
    )
    both = index.join(back, F.col("slot") == F.col("at"), "left")
    same = F.when(F.col("crc") == F.col("ids_crc32"), F.col("crc")).otherwise(
        F.raise_error(F.concat(F.lit("a shard gives back other ids at slot "), F.col("slot").cast("string"))).cast("long")
    )
    return both.select("sequence_id", "slot", "shard", "byte_offset", "n_tokens", same.alias("ids_crc32"), "doc_ids")
