"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

Each document becomes its token ids and one end id; longer ones are cut into
full-length pieces, of which the first takes the remainder.  Full pieces fill a
sequence each.  The others are packed by a grouping genetic algorithm (GGA): a
chromosome is a set of bins; crossover injects whole well-filled bins of one
parent into the other, bins that share a document with them are dissolved, and
their displaced documents are put back by best fit.

Distribution: pieces are dealt by a hash of their row number into problems of about
``problem`` pieces.  A problem whose best-fit packing needs no more bins than its
total length is solved: no search can save a bin.  Every other problem goes to
``islands`` islands, each a population that is a row of a staged table and a task's
work of its own.  An epoch is one pass over all islands of all problems; between two
epochs every island's elite moves to the next island of its problem by a join, and the
state is staged again, so a lost executor costs an epoch at most.

Bins filled to ``accept`` or better are final; the pieces of all other bins go to the
next round, where they are dealt anew, so that poorly filled bins of different
problems are packed together.  After ``rounds`` rounds every bin is final.  No piece is
ever dropped, and a task holds one problem at a time.

Defined results
* null text is the empty text: one piece that holds only the end id.
* repeated rows are packed as often as they occur; null ids stay null.
* equal lengths are interchangeable; the seed decides.
* an empty table gives an empty result; extra columns are ignored by ``pack_documents``.
"""

from __future__ import annotations

import bisect
import itertools
import random
import zlib
from array import array
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from platlark.functions.shared import staged
from platlark.llm import tokens


#: Rows that are held as Python objects at a time.
SLICE = 500
#: Items of a bin among which pairs are tried.
SMALL = 8


@dataclass(frozen=True)
class PackParams:
    capacity: int = 2048
    end_id: int = 0
    problem: int = 4096
    islands: int = 3
    population: int = 3
    epochs: int = 2
    generations: int = 3
    accept: float = 0.998
    rounds: int = 3
    seed: int = 17


def pieces(docs: DataFrame, doc_id: str, text: str, tokenizer: str, params: PackParams, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for every piece of every document."""
    cap, end = params.capacity, params.end_id.to_bytes(4, "little")
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def run(batches):
        encode = tokens.encoder(tokenizer).encode
        for b in (x.slice(i, SLICE) for x in batches for i in range(0, x.num_rows, SLICE)):
            at, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                data = encode(t) + end
                n = len(data) // 4
                start, k = 0, 0
                while start < n:
                    size = (n % cap or cap) if start == 0 else cap
                    part = data[4 * start : 4 * (start + size)]
                    at.append(i)
                    rows.append((k, start, size, zlib.crc32(part), *([part] if keep_ids else [])))
                    start, k = start + size, k + 1
            cols = list(zip(*rows, strict=True)) if rows else [[]] * (4 + keep_ids)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=False))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, schema)


Bins = list[list[int]]


def best_fit(items: list[int], lengths: list[int], cap: int, bins: Bins) -> Bins:
    """Puts ``items``, longest first, each where it leaves the least room; opens bins as needed."""
    room = sorted((cap - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(items, key=lambda i: -lengths[i]):
        at = bisect.bisect_left(room, (lengths[i], -1))
        if at == len(room):
            bins.append([i])
            left = cap - lengths[i], len(bins) - 1
        else:
            space, k = room.pop(at)
            bins[k].append(i)
            left = space - lengths[i], k
        if left[0]:
            bisect.insort(room, left)
    return bins


def fill(b: list[int], lengths: list[int]) -> int:
    return sum(lengths[i] for i in b)


def exchange(displaced: list[int], lengths: list[int], cap: int, bins: Bins) -> list[int]:
    """Swaps one or two items of a bin for one or two displaced ones that fill it better; returns what is displaced then.

    Every displaced item and some pairs of them are kept sorted by length, so the
    best fit for what a bin could give up is found by bisection.  Bins of more than
    ``SMALL`` items are left alone: small items fill a bin well enough.
    """
    free = set(displaced)
    some = sorted(displaced, key=lambda i: lengths[i])[:: max(1, len(displaced) // SMALL)]
    gives = [(lengths[i], (i,)) for i in displaced] + [(lengths[i] + lengths[j], (i, j)) for i, j in itertools.combinations(some, 2)]
    gives.sort()
    sizes = [x[0] for x in gives]
    for b in bins:
        room = cap - fill(b, lengths)
        if not room or len(b) > SMALL or not gives:
            continue
        best = None
        for take in itertools.chain(((i,) for i in b), itertools.combinations(b, 2)):
            out = fill(take, lengths)
            at = bisect.bisect_right(sizes, out + room) - 1
            if at >= 0 and sizes[at] > out and (best is None or sizes[at] - out > best[0]) and free.issuperset(gives[at][1]):
                best = sizes[at] - out, take, gives[at][1]
        if best:
            _, take, give = best
            b[:] = [i for i in b if i not in take] + list(give)
            free.difference_update(give)
            free.update(take)
            for i in take:
                at = bisect.bisect_left(sizes, lengths[i])
                sizes.insert(at, lengths[i])
                gives.insert(at, (lengths[i], (i,)))
    return [i for i in displaced if i in free] + sorted(free.difference(displaced))


def crossover(mother: Bins, father: Bins, lengths: list[int], cap: int, rng: random.Random) -> Bins:
    """The mother with whole well-filled bins of the father; what they displace is exchanged or best-fitted."""
    ranked = sorted(father, key=lambda b: -fill(b, lengths))
    take = ranked[: max(1, len(ranked) // 2)]
    inject = [b for b in take if rng.random() < 0.5] or take[:1]
    inside = {i for b in inject for i in b}
    child, displaced = [list(b) for b in inject], []
    for b in mother:
        if inside.isdisjoint(b):
            child.append(list(b))
        else:
            displaced += [i for i in b if i not in inside]
    return best_fit(exchange(displaced, lengths, cap, child), lengths, cap, child)


def mutate(bins: Bins, lengths: list[int], cap: int, rng: random.Random) -> Bins:
    """Dissolves the emptiest bins and a few others, and places their documents anew."""
    order = sorted(range(len(bins)), key=lambda k: fill(bins[k], lengths))
    gone = set(order[: max(1, len(order) // 20)]) | {rng.randrange(len(bins)) for _ in range(max(2, len(bins) // 10))}
    out = [i for k in gone for i in bins[k]]
    rng.shuffle(out)
    kept = [list(b) for k, b in enumerate(bins) if k not in gone]
    return best_fit(exchange(out, lengths, cap, kept), lengths, cap, kept)


def fitness(bins: Bins, lengths: list[int], cap: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (mean squared fill)."""
    return -len(bins), sum((fill(b, lengths) / cap) ** 2 for b in bins) / max(1, len(bins))


def settle(people: list[Bins], lengths: list[int], params: PackParams, rng: random.Random) -> list[Bins]:
    """A population after some generations, the best first; it keeps its size, and the best is never lost."""
    cap, least = params.capacity, -(-sum(lengths) // params.capacity)
    fit = lambda b: fitness(b, lengths, cap)
    while len(people) < params.population:
        people.append(mutate(people[0], lengths, cap, rng))
    for _ in range(params.generations):
        people.sort(key=fit, reverse=True)
        if len(people[0]) <= least:
            break
        for k in range(max(1, len(people) // 2)):  # the worse half makes room for children
            a, b = rng.sample(range(len(people) - k), 2) if len(people) - k > 1 else (0, 0)
            child = crossover(people[a], people[b], lengths, cap, rng)
            people[-1 - k] = child if len(child) <= least else max(child, mutate(child, lengths, cap, rng), key=fit)
    return sorted(people, key=fit, reverse=True)


def _pack_bins(bins: Bins, n: int) -> bytes:
    out = array("i", [0]) * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out.tobytes()


def _unpack_bins(data: bytes) -> Bins:
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(array("i", data)):
        bins.setdefault(k, []).append(i)
    return list(bins.values())


STATE = "problem int, island int, lengths array<int>, people array<binary>, bins int, least int"


def _state(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.int32(), pa.int32()]
    names = [x.split()[0] for x in STATE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _spread(rows: DataFrame, number: Column) -> DataFrame:
    """Small rows of much work, dealt evenly: partitions are named, so they are not joined for their few bytes."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionById(n, F.pmod(number, F.lit(n)).cast("int"))


def first_packings(problems: DataFrame, params: PackParams) -> DataFrame:
    """The best-fit packing of each problem (problem, lengths), as the state of its island 0."""

    def run(batches):
        for b in batches:
            for problem, lengths in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bins = best_fit(list(range(len(lengths))), lengths, params.capacity, [])
                yield _state([(problem, 0, lengths, [_pack_bins(bins, len(lengths))], len(bins), -(-sum(lengths) // params.capacity))])

    return _spread(problems.select("problem", "lengths"), F.col("problem")).mapInArrow(run, STATE)


def epoch(state: DataFrame, params: PackParams, number: int) -> DataFrame:
    """One epoch on every island: the elite of the island before it arrives, then the generations run."""
    names = [x.split()[0] for x in STATE.split(", ")]
    after = F.pmod(F.col("island") + 1, F.lit(params.islands))
    elite = state.select("problem", after.alias("island"), F.get("people", F.lit(0)).alias("guest"))
    both = _spread(state.join(elite, ["problem", "island"]).select(*names, "guest"), F.col("problem") * params.islands + F.col("island"))

    def run(batches):
        for b in batches:
            for row in b.slice(0).to_pylist():
                rng = random.Random(f"{params.seed} {number} {row['problem']} {row['island']}")
                people = [_unpack_bins(x) for x in row["people"]]
                if number:  # the guest takes the place of the worst
                    people[-1] = _unpack_bins(row["guest"])
                people = settle(people, row["lengths"], params, rng)
                packed = [_pack_bins(x, len(row["lengths"])) for x in people]
                yield _state([(row["problem"], row["island"], row["lengths"], packed, len(people[0]), row["least"])])

    return both.mapInArrow(run, STATE)


def search(problems: DataFrame, params: PackParams) -> DataFrame:
    """(problem, assigned): the bin of every item of each problem (problem, lengths), as int32."""
    state = staged(first_packings(problems, params), "first")
    best = state.select("problem", F.get("people", F.lit(0)).alias("assigned"), "bins")
    state = state.filter((F.col("bins") > F.col("least")) & (F.size("lengths") > 2))
    if not state.head(1):
        return best.drop("bins")
    state = state.drop("island").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(params.islands - 1))))
    state = state.select(*[x.split()[0] for x in STATE.split(", ")])
    for number in range(params.epochs):
        state = staged(epoch(state, params, number), "epoch")
        best = best.union(state.select("problem", F.get("people", F.lit(0)), "bins"))
        solved = state.filter("bins <= least").select("problem").distinct()
        state = state.join(solved, "problem", "left_anti")
        if not state.head(1):
            break
    return best.groupBy("problem").agg(F.min_by("assigned", F.struct("bins", "assigned")).alias("assigned"))


def _round(todo: DataFrame, number: int, params: PackParams, problems: int, base: int) -> DataFrame:
    """``todo`` with sequence_id and offset where a bin is final, null elsewhere; ``base`` problems came before."""
    last = number == params.rounds - 1
    key = F.pmod(F.xxhash64("__p_row", F.lit(params.seed + number)), F.lit(problems)).cast("int")
    items = F.sort_array(F.collect_list(F.struct((-F.col("length")).cast("int").alias("size"), F.col("__p_row").alias("row"))))
    dealt = todo.groupBy(key.alias("problem")).agg(items.alias("items"))
    dealt = dealt.select("problem", F.transform("items", lambda x: -x["size"]).alias("lengths"), F.transform("items", lambda x: x["row"]).alias("rows"))
    dealt = staged(dealt, "problems")
    solved = dealt.join(search(dealt, params), "problem").select("problem", "lengths", "rows", "assigned")

    def run(batches):
        for b in batches:
            for problem, lengths, rows, assigned in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out = []
                for k, items in enumerate(_unpack_bins(assigned)):
                    if last or fill(items, lengths) >= params.accept * params.capacity:
                        at = 0
                        for i in items:
                            out.append((rows[i], ((base + problem) << 24) + k, at))
                            at += lengths[i]
                if out:
                    cols = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["__p_at", "sequence_id", "offset"])

    placed = solved.mapInArrow(run, "__p_at long, sequence_id long, offset long")
    return todo.join(placed, F.col("__p_row") == F.col("__p_at"), "left").drop("__p_at")


def pack(parts: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    parts = staged(parts.withColumn("__p_row", F.monotonically_increasing_id()), "pieces")
    full = parts.filter(F.col("length") == params.capacity)
    todo = parts.filter(F.col("length") < params.capacity)
    done = full.select("*", (F.lit(1 << 60) + F.col("__p_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    base = 0
    for number in range(params.rounds):
        count = todo.count()
        if not count:
            break
        problems = -(-count // params.problem)
        placed = staged(_round(todo, number, params, problems, base), "packed")
        base += problems
        done = done.union(placed.filter("sequence_id is not null"))
        todo = placed.filter("sequence_id is null").drop("sequence_id", "offset")
    return done.drop("__p_row")


def pack_documents(docs, doc_id="doc_id", text="text", tokenizer: str | None = None, params: PackParams = PackParams()) -> DataFrame:
    """One row per piece: its place in its document and in its sequence."""
    return pack(pieces(docs, doc_id, text, tokenizer or tokens.default_path(), params), params)
