"""Near-duplicates by similarity of word shingles: SimHash tables in Gray order, then exact verification.

Equal texts are one node.  Every node has a 128-bit fingerprint of its shingles.  A
table of the index orders the bits of all fingerprints in a way of its own and sorts
them by Gray rank over the whole cluster (a range partition, so no key can fill a
task).  Runs that share their first ``width`` bits are the upper nodes; inside one,
every two fingerprints are compared and those beyond the radius are pruned.  An upper
node of more than ``NODE_ROWS`` rows is cut along the Gray order into blocks that
overlap by ``LAP`` rows.  What a block hands on is a spanning forest of its nearest
pairs, never all pairs.

Recall is part of the design: the width follows the number of fingerprints, so that
upper nodes keep their size, and the number of tables follows the width
(``tables_for``), so that a pair of similarity ``least`` is found with chance
``recall`` at any size.  Where a node was cut, by a block boundary or at the end of a
partition, its rows are handed on as well: they are dealt into blocks by hash, and every two
blocks meet in a task of their own (``whole_nodes``), so no near pair of a node is lost.
That work is quadratic in the node, bounded in memory and spread over the cluster.

Candidates are verified on the whole shingle sets.  First each node verifies its
nearest ``NEAREST`` candidates; then every candidate whose ends verified links have not
joined yet is verified as well.

A candidate that is rejected may have stood for others in its forest: texts of one
template lie near each other without being alike.  So every text whose candidates, over any number
of steps, lead to a rejected one goes through tables a second time with its shingle set beside it, and
there a node verifies all its near pairs before its forest is taken: a spanning forest of
true links joins whatever the links join.  Width and number of those tables follow the
number of such texts, with chance ``SECOND`` to meet.

Defined results
* null text is the empty text; texts without words are alike.
* the row with the smallest (id, text digest) of a group stays; of rows with equal id
  and text one stays.  Rows of one id with different texts are judged each by its text.
* rows with a null id are neither compared nor dropped.
* ids may be of any type that can be ordered; an empty table stays empty; extra columns
  are carried whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from platlark.functions.shared import large, staged
from platlark.llm.simhash import fingerprint_batch, shingles
from platlark.operators.graph import connected_components

BITS = 128
#: Of texts that go through tables again: the chance that a true link meets, and the least width.
SECOND, SECOND_WIDTH = 0.98, 8
NODE_ROWS, LAP, NEAREST = 1024, 256, 4
#: Rows of a block of a node that was cut, without and with their shingle sets beside them.
BLOCK, SET_BLOCK = 1024, 512
#: Rows that an upper node has on average once the corpus is large enough.
NODE_MEAN, LEAST_WIDTH = 256, 10


def agreement(least: float) -> float:
    """The chance that a bit of two texts agrees whose shingle sets have this Jaccard similarity."""
    return 1 - math.acos(2 * least / (1 + least)) / math.pi


def width_for(n: int) -> int:
    """Leading bits that an upper node shares, for ``n`` fingerprints."""
    return max(LEAST_WIDTH, math.ceil(math.log2(max(n, 1) / NODE_MEAN)))


def tables_for(width: int, least: float, recall: float) -> int:
    """Tables with which two texts of this similarity share an upper node at least once with chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement(least) ** width))


def digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _codes(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(id, sha, code) of every row."""
    rows = docs.select(F.col(doc_id).alias("id"), digest(F.col(text)).alias("sha"), F.col(text).cast("binary").alias("t"))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for b in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            code = fingerprint_batch(b.column(2).to_pylist(), shingle, BITS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.binary())], ["id", "sha", "code"])

    return rows.filter("id is not null").mapInArrow(run, f"id {kind}, sha binary, code binary")


def orders(tables: int, seed: int = 7) -> np.ndarray:
    """(tables, BITS): the order of the bits in each table."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(BITS) for _ in range(tables)])


def nearest_forest(m: int, q: np.ndarray, j: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Numbers of the edges (q, j) of a minimum spanning forest by ``apart``: every part takes its nearest edge, round by round."""
    label = np.arange(m)
    edges = np.arange(len(q))
    out = []
    while True:
        a, b = label[q[edges]], label[j[edges]]
        edges, a, b = (x[a != b] for x in (edges, a, b))
        if not len(edges):
            return np.concatenate(out) if out else edges
        key = apart[edges].astype(np.int64) * len(q) + edges  # no two are equal, so the picks have no cycle
        best = np.full(m, np.iinfo(np.int64).max)
        np.minimum.at(best, a, key)
        np.minimum.at(best, b, key)
        pick = np.unique(best[best < np.iinfo(np.int64).max]) % len(q)
        out.append(pick)
        a, b = label[q[pick]], label[j[pick]]
        parent = np.arange(m)
        while (parent[a] != parent[b]).any():  # parts that the picks join take their smallest label
            low = np.minimum(parent[a], parent[b])
            np.minimum.at(parent, a, low)
            np.minimum.at(parent, b, low)
            parent = parent[parent]
        label = parent[label]


def block_pairs(lanes: np.ndarray, end: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, j, apart) of the rows q < j < end[q] that differ in at most ``radius`` bits."""
    out, rows, k = [], np.arange(len(lanes)), 0
    while True:
        k += 1
        rows = rows[end[rows] > rows + k]
        if not len(rows):
            break
        apart = np.bitwise_count(lanes[rows] ^ lanes[rows + k]).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(apart <= radius)
        if len(near):
            out.append(np.stack([rows[near], rows[near] + k, apart[near]]))
    return tuple(np.concatenate(out, axis=1)) if out else (np.zeros(0, np.int64),) * 3


def cross_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, j, apart) of the rows q of ``a`` and j of ``b`` that differ in at most ``radius`` bits."""
    out = []
    for at in range(0, len(a), 64):
        apart = np.bitwise_count(a[at : at + 64, None] ^ b[None]).sum(axis=2, dtype=np.int64)
        q, j = np.nonzero(apart <= radius)
        out.append(np.stack([q + at, j, apart[q, j]]))
    return tuple(np.concatenate(out, axis=1)) if out else (np.zeros(0, np.int64),) * 3


def alike_pairs(sets: list[bytes], q: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Whether the shingle sets of each pair (q, j) are alike: shingles that two sets hold are bits, counted where both are set."""
    parts = [np.frombuffer(s, np.uint32) for s in sets]
    size = np.array([len(x) for x in parts])
    _, at, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint32), return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1
    held = n[at] > 1
    wide = -(-max(1, int((n > 1).sum())) // 64) * 64
    bits = np.zeros((len(sets), wide), bool)
    bits[np.repeat(np.arange(len(sets)), size)[held], column[at[held]]] = True
    lanes = np.packbits(bits, axis=1).view(np.uint64)
    out = np.zeros(len(q), bool)
    step = max(1, (1 << 22) // lanes.shape[1])
    for i in range(0, len(q), step):
        a, b = q[i : i + step], j[i : i + step]
        common = np.bitwise_count(lanes[a] & lanes[b]).sum(axis=1, dtype=np.int64)
        out[i : i + step] = common >= least * (size[a] + size[b] - common)  # two empty sets are alike
    return out


def sorted_links(ranks: np.ndarray, node: np.ndarray, radius: int, sets: list[bytes] | None = None, least: float = 0.8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, j, apart): forests of near pairs among rows sorted by (node, rank); ``ranks`` are (m, bytes) of uint8.

    With the rows' shingle sets only alike pairs count.
    """

    def checked(first: int, last: int, q, j, apart):
        if sets is None or not len(q):
            return q, j, apart
        keep = alike_pairs(sets[first:last], q - first, j - first, least)
        return q[keep], j[keep], apart[keep]

    m = len(ranks)
    flat = np.unpackbits(ranks, axis=1)
    flat[:, 1:] ^= flat[:, :-1].copy()  # a Gray rank back to its code
    lanes = np.packbits(flat, axis=1).view(np.uint64)
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    size = np.diff(np.append(first, m))
    end = np.repeat(first + size, size)
    out = []
    large = np.repeat(size > 64, size)
    end_small = np.where(large, 0, end)
    q, j, apart = block_pairs(lanes, end_small, radius)
    if sets is not None:  # small nodes are verified some thousand rows at a time
        order = np.argsort(q, kind="stable")
        q, j, apart = q[order], j[order], apart[order]
        cuts = [0, *np.flatnonzero(np.diff(first[np.searchsorted(first, q, "right") - 1] // NODE_ROWS)) + 1, len(q)] if len(q) else [0]
        done = [checked(int(q[a]), int(j[a:b].max()) + 1, q[a:b], j[a:b], apart[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        q, j, apart = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (q, j, apart)
    keep = nearest_forest(m, q, j, apart)
    out.append((q[keep], j[keep], apart[keep]))
    for f, k in zip(first[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        step = k if k <= NODE_ROWS else NODE_ROWS - LAP
        for at in range(0, k, step):
            part = lanes[f + at : f + min(k, at + NODE_ROWS)]
            q, j, apart = block_pairs(part, np.full(len(part), len(part)), radius)
            if sets is not None:
                keep = alike_pairs(sets[f + at : f + at + len(part)], q, j, least)
                q, j, apart = q[keep], j[keep], apart[keep]
            keep = nearest_forest(len(part), q, j, apart)
            out.append((q[keep] + f + at, j[keep] + f + at, apart[keep]))
            if at + NODE_ROWS >= k:
                break
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def candidates(nodes: DataFrame, radius: int, width: int, tables: int) -> DataFrame:
    """(src, dst, apart), src < dst: pairs of ``nodes`` (node, code) that some table puts near each other, those that a cut parts included."""
    return _near_in_tables(nodes, radius, width, tables)


def _near_in_tables(nodes: DataFrame, radius: int, width: int, tables: int, least: float | None = None, seed: int = 7) -> DataFrame:
    """``candidates``; with ``least``, ``nodes`` have their shingle sets as ``s`` and pairs are links, verified where they meet."""
    order = orders(tables, seed)
    names = ["node", "code"] + (["s"] if least is not None else [])

    def spread(batches):
        for b in (x.slice(i, 2000) for x in batches for i in range(0, x.num_rows, 2000)):
            flat = np.unpackbits(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, BITS // 8), axis=1)
            for k, bits in enumerate(order):
                rank = np.packbits(np.bitwise_xor.accumulate(flat[:, bits], axis=1), axis=1)
                held = pa.Array.from_buffers(pa.binary(BITS // 8), len(rank), [None, pa.py_buffer(rank.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rank), k, np.int32)), held.cast(pa.binary()), b.column(0), *b.columns[2:]], ["k", "rank", "node", *names[2:]])

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select(*names).mapInArrow(spread, "k int, rank binary, node long" + (", s binary" if least is not None else ""))
    rows = rows.repartitionByRange(n, "k", "rank").sortWithinPartitions("k", "rank")
    lead = -(-width // 8)
    mask = np.frombuffer((((1 << width) - 1) << (8 * lead - width)).to_bytes(lead, "big"), np.uint8)

    def links(batches):
        rest, part, opened = None, TaskContext.get().partitionId(), True  # opened: the first node may have begun before
        for b in _ended(batches):
            t = rest if b is None else pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b])
            if t is None or not len(t):
                continue
            t = t.combine_chunks()
            rank = np.frombuffer(b"".join(t.column(1).to_pylist()), np.uint8).reshape(-1, BITS // 8)
            head = np.zeros((len(rank), 12), np.uint8)
            head[:, :4] = t.column(0).to_numpy().astype(">i4").view(np.uint8).reshape(-1, 4)
            head[:, 4 : 4 + lead] = rank[:, :lead] & mask
            new = np.flatnonzero(np.append(True, (head[1:] != head[:-1]).any(axis=1)))
            stop = carry = len(rank) if b is None else int(new[-1])
            if len(rank) - stop > 4 * NODE_ROWS:  # a node that goes on: it is searched so far, an overlap is carried
                stop, carry = len(rank), len(rank) - LAP
            rest = t.slice(carry)
            if not stop:
                continue
            number = np.zeros(stop, np.int64)
            number[new[(new > 0) & (new < stop)]] = 1
            number = np.cumsum(number)
            torn = np.bincount(number) > NODE_ROWS
            torn[0] |= opened
            torn[-1] |= b is None
            opened = carry < stop
            held = np.flatnonzero(torn[number])
            if len(held):
                heads = [h[: 4 + lead].tobytes() for h in head[held]]
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(held), pa.int64()), t.column(2).combine_chunks().take(pa.array(held)), pa.array(np.full(len(held), part, np.int32)), pa.array(heads, pa.binary())], columns
                )
            sets = t.column(3).slice(0, stop).to_pylist() if least is not None else None
            q, j, apart = sorted_links(rank[:stop], number, radius, sets, least or 0)
            ids = t.column(2).to_numpy()
            if len(q):
                a, z = ids[q], ids[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, z)), pa.array(np.maximum(a, z)), pa.array(apart.astype(np.int32)), pa.nulls(len(q), pa.binary())], columns)

    columns = ["src", "dst", "apart", "head"]
    # rows without src are the rows of nodes that may have been cut: node, partition, head
    found = staged(rows.mapInArrow(links, "src long, dst long, apart int, head binary"), "found")
    torn = found.filter("src is null").select("head", F.col("dst").alias("node"), F.col("apart").alias("part"))
    found = found.filter("src is not null").select("src", "dst", "apart").unionByName(whole_nodes(torn, nodes.select(*names), radius, least))
    return found.groupBy("src", "dst").agg(F.min("apart").alias("apart"))


def whole_nodes(torn: DataFrame, nodes: DataFrame, radius: int, least: float | None = None) -> DataFrame:
    """(src, dst, apart): forests of the near pairs of every two blocks of each node that was cut.

    torn: head, node, part, all rows of nodes that are overfull or stand at an end of a partition.
    """
    block = BLOCK if least is None else SET_BLOCK
    rows = torn.groupBy("head", "node").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    size = rows.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    size = size.filter((F.col("n") > NODE_ROWS) | (F.col("lo") < F.col("hi"))).select("head", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = rows.select("head", "node").join(large(size), "head").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.join(large(nodes), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = [F.col("s")] if least is not None else []
    rows = rows.select("head", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "code", *sets)

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        side = t.column("block").to_numpy()
        order = np.argsort(side, kind="stable")
        t, n = t.take(pa.array(order)), int((side == side.min()).sum())
        lanes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(-1, BITS // 8).view(np.uint64)
        if t.column("i")[0].as_py() == t.column("j")[0].as_py():
            q, j, apart = block_pairs(lanes, np.full(len(lanes), len(lanes)), radius)
        else:
            q, j, apart = cross_pairs(lanes[:n], lanes[n:], radius)
            j = j + n
        if least is not None and len(q):
            keep = alike_pairs(t.column("s").to_pylist(), q, j, least)
            q, j, apart = q[keep], j[keep], apart[keep]
        keep = nearest_forest(len(lanes), q, j, apart)
        ids = t.column("node").to_numpy()
        a, z = ids[q[keep]], ids[j[keep]]
        return pa.table([pa.array(np.minimum(a, z), pa.int64()), pa.array(np.maximum(a, z), pa.int64()), pa.array(apart[keep].astype(np.int32))], ["src", "dst", "apart"])

    return rows.groupBy("head", "i", "j").applyInArrow(run, "src long, dst long, apart int")


def _ended(batches):
    yield from batches
    yield None


def shingle_set(text: bytes | None, size: int) -> bytes:
    """32-bit hashes of the distinct shingles, sorted."""
    h = np.fromiter(map(xxhash.xxh32_intdigest, shingles(text or b"", size)), dtype=np.uint32)
    return np.unique(h).tobytes()


def _alike(a: bytes, b: bytes, least: float) -> bool:
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return common >= least * (len(x) + len(y) - common)  # two empty sets are alike


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The rows (src, dst) of ``pairs`` whose sets (node, s) are alike."""
    both = pairs.select("src", "dst").join(sets.withColumnsRenamed({"node": "src", "s": "a"}), "src")
    both = both.join(sets.withColumnsRenamed({"node": "dst", "s": "b"}), "dst").select("src", "dst", "a", "b")

    def run(batches):
        for b in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            a, z = b.column(2).to_pylist(), b.column(3).to_pylist()
            keep = pa.array([_alike(x, y, least) for x, y in zip(a, z, strict=True)], pa.bool_())
            yield b.select([0, 1]).filter(keep)

    return both.mapInArrow(run, "src long, dst long")


def links(docs: DataFrame, nodes: DataFrame, repeated: bool, doc_id: str, text: str, shingle: int, least: float, recall: float, slack: float) -> DataFrame:
    """Verified links (src, dst) that join all nodes which verified candidates connect."""
    width = width_for(nodes.count())
    radius = int(BITS * (1 - agreement(least) + slack))
    pairs = staged(candidates(nodes, radius, width, tables_for(width, least, recall)), "pairs")
    ends = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
    held = nodes.join(ends, "node").select("node", F.col("id").alias("__n_id"), F.col("sha").alias("__n_sha"))
    texts = docs.select(F.col(doc_id).alias("__n_id"), F.col(text).alias("t")).withColumn("__n_sha", digest(F.col("t")))

    def sets_of(batches):
        for b in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            s = [shingle_set(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.binary())], ["node", "s"])

    sets = texts.join(held, ["__n_id", "__n_sha"]).select("node", F.col("t").cast("binary").alias("t")).mapInArrow(sets_of, "node long, s binary")
    sets = staged(sets.dropDuplicates(["node"]) if repeated else sets, "sets")
    both = pairs.select("src", "dst", "apart").union(pairs.select("dst", "src", "apart")).toDF("u", "v", "apart")
    near = both.withColumn("at", F.row_number().over(W.partitionBy("u").orderBy("apart", "v"))).filter(F.col("at") <= NEAREST)
    near = near.select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).distinct()
    near = staged(near, "near")
    first = staged(verified(near, sets, least), "links")
    label = staged(connected_components(first), "labels")
    of = lambda end: label.select(F.col("node").alias(end), F.col("component").alias(f"{end}_label"))
    rest = pairs.join(near, ["src", "dst"], "left_anti").join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    rest = staged(rest.filter(F.coalesce("src_label", "src") != F.coalesce("dst_label", "dst")).select("src", "dst"), "rest")
    later = staged(verified(rest, sets, least), "later")
    return first.union(later).union(second_look(nodes, sets, pairs, near.union(rest), first.union(later), radius, least))


def second_look(nodes: DataFrame, sets: DataFrame, pairs: DataFrame, tried: DataFrame, good: DataFrame, radius: int, least: float) -> DataFrame:
    """(src, dst): links among the texts whose candidates lead to a rejected one, verified in their nodes."""
    refused = staged(tried.join(good, ["src", "dst"], "left_anti"), "refused")
    if not refused.head(1):
        return refused
    whole = connected_components(pairs).withColumnRenamed("component", "part")
    parts = whole.join(refused.select(F.col("src").alias("node")), "node", "left_semi").select("part").distinct()
    again = whole.join(parts, "part", "left_semi").select("node").join(nodes.select("node", "code"), "node").join(sets, "node")
    again = staged(again.select("node", "code", "s"), "again")
    width = max(SECOND_WIDTH, width_for(again.count()) if again.count() > NODE_MEAN << SECOND_WIDTH else SECOND_WIDTH)
    return _near_in_tables(again, radius, width, tables_for(width, least, SECOND), least, seed=11).select("src", "dst")


def deduplicate(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    least: float = 0.8,
    recall: float = 0.95,
    slack: float = 0.12,
) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest id.

    Two texts with a Jaccard similarity of ``least`` differ in about 15 % of the
    fingerprint's bits; candidates may differ in ``slack`` more.
    """
    codes = staged(_codes(docs, doc_id, text, shingle), "codes")
    rows = staged(codes.groupBy("id", "sha").agg(F.first("code").alias("code"), F.count(F.lit(1)).alias("n")), "rows")
    repeated = bool(rows.filter("n > 1").head(1))
    nodes = rows.groupBy("sha").agg(F.min("id").alias("id"), F.first("code").alias("code"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = links(docs, nodes, repeated, doc_id, text, shingle, least, recall, slack)
    group = connected_components(found)
    placed = nodes.join(group, "node", "left").select("sha", "id", F.coalesce("component", "node").alias("group"))
    stays = placed.groupBy("group").agg(F.min(F.struct("id", "sha")).alias("s")).select("s.id", "s.sha")
    stays = staged(stays, "stays")
    name = {"id": "__n_id", "sha": "__n_sha"}
    gone = rows.join(stays, ["id", "sha"], "left_anti").select("id", "sha").withColumnsRenamed(name)
    twice = rows.filter("n > 1").join(stays, ["id", "sha"], "left_semi").select("id", "sha").withColumnsRenamed(name)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.select(F.struct(*columns).alias("__n_row"), F.col(doc_id).alias("__n_id"), digest(F.col(text)).alias("__n_sha"))
    out = out.join(gone, ["__n_id", "__n_sha"], "left_anti")
    if repeated:
        again = out.join(twice, ["__n_id", "__n_sha"], "left_semi").dropDuplicates(["__n_id", "__n_sha"])
        out = out.join(twice, ["__n_id", "__n_sha"], "left_anti").unionByName(again)
    return out.select("__n_row.*")
