"""Training-data operators on small tables against brute force: copies, ties, nulls, empty tables, clashing names."""

import hashlib
import html
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from platlark.llm import imatch, mixing, native_quality as Q, neardup, ordering, packing, simhash, spans, templates, url_rules, warc

WORDS = [a + b for a in ("ba", "do", "ki", "lu", "mer", "no") for b in ("ra", "ten", "sil", "vo", "quin")]


def prose(rng, n):
    """Sentences of six to eleven words."""
    out = []
    while n > 0:
        k = min(n, rng.randrange(6, 12))
        out.append(" ".join(rng.choice(WORDS) for _ in range(k)).capitalize() + ".")
        n -= k
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [prose(rng, rng.randrange(60, 200)) for _ in range(25)]
    texts = base + base[:3] + [base[0].replace("ba", "do", 1), None, "", " \n\t ", "one", "two words", "é\xa0é é " * 40, "x " * 70, prose(rng, 6000)]
    return [(i, t, "abc"[i % 3] if i % 7 else None) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ")


def test_quality_base_columns(spark, docs, rows):
    out = {r.doc_id: r for r in Q.quality(docs, docs.filter("doc_id < 20").select("doc_id")).collect()}
    assert len(out) == len(rows)
    for i, t, _ in rows:
        t = t or ""
        w = [x for x in t.replace("\t", " ").replace("\n", " ").split(" ") if x]
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered)), i
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.kept and r.base_failed)


def test_quality_learns_and_keeps_columns(spark):
    rng = random.Random(1)
    good = [(i, prose(rng, 120), "ok") for i in range(60)]
    junk = [(100 + i, " ".join(rng.choice(["$$$aa", "###bb", "%%%cc", "&&&dd"]) + str(rng.randrange(60)) for _ in range(120)), "junk") for i in range(20)]
    df = spark.createDataFrame(good + junk, "doc_id long, text string, kept string")
    kept = Q.keep_good(df, df.filter("doc_id < 30").select("doc_id"))
    assert kept.columns == df.columns
    assert {r.kept for r in kept.collect()} == {"ok"} and kept.count() == 60
    assert Q.keep_good(df.limit(0), df.select("doc_id")).count() == 0
    flat = Q.quality(df, df.limit(0).select("doc_id"))
    assert all(r.kept != r.base_failed for r in flat.collect())


def fingerprint(t):
    w = [x for x in words(t) if x]
    g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(docs, rows):
    got = {r.id: r for r in simhash.components(docs).collect()}
    codes = {i: fingerprint(t) for i, t, _ in rows}
    assert {i: r.code.hex() for i, r in got.items()} == {i: f"{c:016x}" for i, c in codes.items()}
    root = {i: i for i in codes}
    for a, b in itertools.combinations(sorted(codes), 2):
        if (codes[a] ^ codes[b]).bit_count() <= 2:
            x, y = root[a], root[b]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert {i: r.component for i, r in got.items()} == root


@pytest.mark.parametrize("radius", [0, 2, 9])
def test_index_node_matches_all_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 256, (30, 8), dtype=np.uint8)
    codes = np.concatenate([base, base[:20] ^ np.uint8(1), base[:10] ^ np.uint8(3), base[:5]])
    label = np.arange(len(codes))
    for a, b in itertools.combinations(range(len(codes)), 2):
        if np.bitwise_count(codes[a] ^ codes[b]).sum() <= radius:
            label[label == label[b]] = label[a]
    mine = np.arange(len(codes))
    links = simhash.node_links(codes, radius, block=16)
    for a, b in links:
        assert np.bitwise_count(codes[a] ^ codes[b]).sum() <= radius
        mine[mine == mine[b]] = mine[a]
    pairs = {(x, y) for x, y in zip(label, mine, strict=True)}
    assert len(pairs) == len(set(label)) == len(set(mine)) == len(codes) - len(links)


def test_overfull_nodes_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_ROWS", 8)
    codes = [(i, (i * 3).to_bytes(8, "big")) for i in range(60)]
    df = spark.createDataFrame(codes, "id long, code binary")
    found = {tuple(sorted((r.src, r.dst))) for r in simhash.search(df, 64, 2).collect()}
    label = {i: i for i, _ in codes}
    mine = dict(label)
    merge = lambda m, a, b: {k: m[a] if v == m[b] else v for k, v in m.items()}
    for a, b in itertools.combinations(range(60), 2):
        if (a * 3 ^ b * 3).bit_count() <= 2:
            label = merge(label, a, b)
    for a, b in found:
        assert (a * 3 ^ b * 3).bit_count() <= 2
        mine = merge(mine, a, b)
    assert len(set(label.values())) == len(set(mine.values()))


def test_near_dedup_keeps_one_of_each_group(spark, docs, rows):
    kept = {r.doc_id for r in neardup.deduplicate(docs).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := [x for x in words(t) if x]) else set() for i, t, _ in rows}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert kept == {i for i, r in root.items() if i == r}
    twice = docs.union(docs).withColumn("component", F.lit("mine"))
    again = neardup.deduplicate(twice)
    assert again.columns == twice.columns and again.count() == len(kept)


def test_near_dedup_finds_links_behind_rejected_ones(spark, monkeypatch):
    rng = random.Random(12)
    shared = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    own = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    loose = " ".join(shared + own(100))
    tail = own(100)
    texts = [loose, " ".join(shared + tail), " ".join(shared + tail[:-10] + own(10)), " ".join(shared + own(100))]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    monkeypatch.setattr(neardup, "NEAREST", 1)
    real = neardup.candidates

    def rejected_are_nearest(nodes, *rest):  # each node's nearest candidate is one that does not hold
        n = {r.id: r.node for r in nodes.collect()}
        held = {tuple(sorted((n[a], n[b]))): d for a, b, d in ((1, 2, 0), (1, 3, 0), (1, 4, 0), (2, 3, 5), (3, 4, 6))}
        assert real(nodes, *rest).columns == ["src", "dst", "apart"]
        return spark.createDataFrame([(*k, d) for k, d in held.items()], "src long, dst long, apart int")

    monkeypatch.setattr(neardup, "candidates", rejected_are_nearest)
    assert {r.doc_id for r in neardup.deduplicate(df).collect()} == {1, 2, 4}


@pytest.mark.parametrize("seed", range(4))
def test_nearest_forest_spans_every_threshold(seed):
    rng = np.random.default_rng(seed)
    m = 60
    q, j = (x.ravel() for x in np.meshgrid(np.arange(m), np.arange(m)))
    q, j = q[q < j], j[q < j]
    some = rng.random(len(q)) < 0.08
    q, j = q[some], j[some]
    apart = rng.integers(0, 6, len(q))

    def parts(edges):
        label = np.arange(m)
        for a, b in edges:
            label[label == label[b]] = label[a]
        return len(set(label))

    keep = neardup.nearest_forest(m, q, j, apart)
    for most in range(6):
        whole, forest = apart <= most, keep[apart[keep] <= most]
        assert parts(zip(q[whole], j[whole], strict=True)) == parts(zip(q[forest], j[forest], strict=True)) == m - len(forest)


def test_near_dedup_index_against_all_pairs(spark):
    """Measured recall of whole groups: 300 texts, each with a copy of similarity 0.8 to 0.9, at a width of 16 bits."""
    rng = random.Random(21)
    rows, at = [], 0
    for _ in range(300):
        w = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        k = rng.randrange(15, 30)
        start = rng.randrange(0, 300 - k)
        rows += [(at, " ".join(w)), (at + 1, " ".join(w[:start] + [f"x{rng.randrange(10**6)}" for _ in range(k)] + w[start + k :]))]
        at += 2
    df = spark.createDataFrame(rows, "node long, t string")
    codes = df.select("node", F.col("t").cast("binary").alias("t")).toArrow()
    code = simhash.fingerprint_batch(codes.column(1).to_pylist(), 5, neardup.BITS)
    nodes = spark.createDataFrame(list(zip(codes.column(0).to_pylist(), map(bytearray, code), strict=True)), "node long, code binary")
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(296)} for i, t in rows}
    true = {(i, i + 1) for i in range(0, at, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    for width in (10, 16):
        tables = neardup.tables_for(width, 0.8, 0.95)
        found = {(r.src, r.dst) for r in neardup.candidates(nodes, 34, width, tables).collect()}
        assert len(true & found) >= 0.93 * len(true) and len(found) < 3 * len(true)


def test_near_dedup_nodes_and_tables_follow_the_size():
    for n in (10, 10**4, 10**6, 10**9, 10**11):
        width = neardup.width_for(n)
        assert n / 2**width <= neardup.NODE_MEAN
        assert 1 - (1 - neardup.agreement(0.8) ** width) ** neardup.tables_for(width, 0.8, 0.95) >= 0.95


def test_near_dedup_cuts_overfull_nodes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "NODE_ROWS", 24)
    monkeypatch.setattr(neardup, "LAP", 8)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(150):  # one group of near copies that are all different
        w = list(base)
        w[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    other = [" ".join(f"y{rng.randrange(10**6)}" for _ in range(100)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts + other)), "doc_id long, text string")
    assert {r.doc_id for r in neardup.deduplicate(df).collect()} == {0, *range(150, 180)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)  # nodes that go on over several batches
    try:
        assert {r.doc_id for r in neardup.deduplicate(df).collect()} == {0, *range(150, 180)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_near_dedup_defined_cases(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [("b", long), ("a", long), ("a", long), ("a", "another text " * 9), (None, long), (None, long), ("c", None), ("d", ""), ("e", " \n")]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("sha", F.lit(1)).withColumn("code", F.lit("x")).withColumn("n", F.lit(2))
    got = neardup.deduplicate(df)
    assert got.columns == df.columns
    out = sorted((r.doc_id or "", (r.text or "")[:7]) for r in got.collect())
    assert out == [("", "w0 w1 w"), ("", "w0 w1 w"), ("a", "another"), ("a", "w0 w1 w"), ("c", "")]
    assert neardup.deduplicate(df.limit(0)).count() == 0


def test_spans_match_brute_force(spark, docs, rows):
    rng = random.Random(9)
    passage = prose(rng, 70)
    planted = [(900, prose(rng, 40) + " " + passage + " " + prose(rng, 40), None), (901, passage + "\n" + prose(rng, 60), None), (902, prose(rng, 60) + " " + passage, None)]
    df = docs.union(spark.createDataFrame(planted, SCHEMA)).withColumn("n_removed", F.lit("mine"))
    got = {r.doc_id: r for r in spans.remove_repeats(df).collect()}
    seen: dict = {}
    for i, t, _ in [*rows, *planted]:
        for h, at, n in spans.runs(t or ""):
            seen.setdefault(h, []).append((i, at * 4 + n))
    gone: dict = {}
    for places in seen.values():
        for i, p in places:
            if (i, p) != min(places):
                gone.setdefault(i, set()).add(p)
    for i, t, _ in [*rows, *planted]:
        assert got[i].text == (spans.strip(t, gone[i])[0] if i in gone else t)
    assert passage in got[900].text
    first = passage.split(". ")[0]
    assert first not in got[901].text and first not in got[902].text
    assert spans.remove_repeats(df.limit(0)).count() == 0


def test_poisson_counts(spark):
    df = spark.createDataFrame([(i, "x" * (5 if i % 4 else 20), "big" if i % 4 else "small") for i in range(4000)], SCHEMA)
    out = mixing.mix(df.withColumn("copy", F.lit("mine")), weights={"big": 1.0, "small": 3.0})
    rows = out.collect()
    share = Counter()
    for r in rows:
        share[r.source] += len(r.text)
    assert share["small"] / (share["small"] + share["big"]) == pytest.approx(0.75, abs=0.03)
    assert [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows)
    assert all(r.shuffle_key == hashlib.md5(f"{r.doc_id}:42:order:{r.copy}".encode()).hexdigest() for r in rows)
    copies = Counter(r.doc_id for r in rows)
    big = [copies[i] for i in range(4000) if i % 4]
    mean = 0.25 * 35000 / 15000
    assert np.mean(big) == pytest.approx(mean, abs=0.05) and np.var(big) == pytest.approx(mean, abs=0.08)
    assert mixing.mix(df.limit(0)).count() == 0
    heavy = mixing.mix(df.filter("doc_id < 40"), epochs=30.0)
    assert heavy.count() == pytest.approx(40 * 30, rel=0.2)


def test_packing_round_trip(docs, rows):
    got = packing.pack_documents(docs).collect()
    encode = packing.tokens.encoder(packing.tokens.default_path())
    for i, t, _ in rows:
        ids = np.append(np.frombuffer(encode.encode(t), dtype="<u4"), 0).astype("<u4")
        parts = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        at = 0
        for k, p in enumerate(parts):
            assert (p.piece, p.start) == (k, at) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids) and (len(ids) > 2048 or len(parts) == 1)
    bins: dict = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert all(o == sum(n for _, n in b[:k]) for k, (o, _) in enumerate(b)) and sum(n for _, n in b) <= 2048
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_packing_of_several_problems_shares_no_sequence(spark):
    rng = random.Random(6)
    rows = [(i, 0, 0, rng.randrange(1, 1500), i) for i in range(300)]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(parts, packing.PackParams(problem=20)).collect()
    assert sorted(r.doc_id for r in got) == list(range(300))
    bins: dict = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert all(o == sum(n for _, n in b[:k]) for k, (o, _) in enumerate(b)) and sum(n for _, n in b) <= 2048


def test_tokens_are_the_tokenizers_own():
    e = packing.tokens.encoder(packing.tokens.default_path())
    for t in ["a  b", "don't it's\t\tx  ", " x", "x ", "a\xa0b", "<|endoftext|> x", "a\n \nb", "日本 語 \n", "x\r\n y 12.5 'll", "a \nb"]:
        assert np.frombuffer(e.encode(t), dtype="<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def triplets(rng, bins, cap=2048):
    """Lengths that fill ``bins`` bins exactly, three to a bin: best fit needs more."""
    out = []
    for _ in range(bins):
        a = rng.randrange(cap * 38 // 100, cap * 49 // 100)
        b = rng.randrange(cap // 4, (cap - a) // 2)
        out += [a, b, cap - a - b]
    rng.shuffle(out)
    return out


def test_generations_lose_no_item_and_no_bin():
    rng = random.Random(3)
    params = packing.PackParams(generations=3, population=3)
    for lengths in ([rng.randrange(1, 1500) for _ in range(400)], triplets(rng, 30), [2047] * 9, [5]):
        first = packing.best_fit(list(range(len(lengths))), lengths, 2048, [])
        for bins in packing.settle([first], lengths, params, rng):
            assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
            assert all(sum(lengths[i] for i in b) <= 2048 for b in bins)
            assert packing._unpack_bins(packing._pack_bins(bins, len(lengths))) is not None
        assert len(packing.settle([first], lengths, params, rng)[0]) <= len(first)


def test_islands_beat_best_fit_where_the_bound_is_not_met(spark):
    rng = random.Random(8)
    problems = [(k, triplets(rng, 20)) for k in range(3)] + [(3, [1024] * 8)]
    df = spark.createDataFrame(problems, "problem int, lengths array<int>")
    params = packing.PackParams(islands=3, population=8, epochs=4, generations=12)
    found = {r.problem: packing._unpack_bins(r.assigned) for r in packing.search(df, params).collect()}
    fitted = sum(len(packing.best_fit(list(range(len(x))), x, 2048, [])) for _, x in problems)
    for k, lengths in problems:
        assert sorted(i for b in found[k] for i in b) == list(range(len(lengths))) and all(packing.fill(b, lengths) <= 2048 for b in found[k])
    assert sum(map(len, found.values())) < fitted and len(found[3]) == 4


def test_packing_of_repeated_rows_and_clashing_columns(spark):
    rows = [(None, "one two", 1), (None, "one two", 1), (3, None, 2), (3, None, 2), (3, "x " * 5000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").withColumn("sequence_id", F.lit("x")).withColumn("piece", F.lit(None).cast("string"))
    got = packing.pack_documents(df, params=packing.PackParams(problem=2)).collect()
    assert Counter(r.doc_id for r in got if r.length < 10) == {None: 2, 3: 2}
    assert sum(r.length for r in got if r.doc_id == 3) == 2 + next(r.start + r.length for r in got if r.doc_id == 3 and r.piece > 0 and r.start + r.length > 4000)


def test_warc_round_trip(spark):
    pages = [(1, "http://a/", "x" * 100), (2, None, "x" * 100), (3, "u", None), (4, "u", ""), (5, "u", "é" * 50_000), (6, "u", "a\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = {r.page_id: r for r in warc.round_trip(df, params=warc.WarcParams(segment=1000, chunk=77)).collect()}
    first: dict = {}
    for i, _, h in pages:
        b = (h or "").encode()
        refers = first.setdefault(b, i)
        want = (len(b), warc.digest(b), "response", None) if refers == i else (len(b), warc.digest(b), "revisit", refers)
        assert tuple(got[i])[1:] == want
    small = warc.round_trip(df, params=warc.WarcParams(min_revisit=50))
    assert {r.page_id for r in small.filter("record_type = 'revisit'").collect()} == {2}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_keeps_every_row_of_null_and_repeated_ids(spark):
    big = "z" * 5000
    pages = [(None, "n", "y" * 4000), (None, "n", big), (1, "a", big), (1, "b", "y" * 4000), (1, "b", "y" * 4000), (7, "c", "y" * 4000), (7, None, None), (7, None, None), (None, "q", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("row", F.lit("x")).withColumn("refers", F.lit(1))
    got = warc.round_trip(df, params=warc.WarcParams(segment=1000, chunk=300)).collect()
    rows = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got)
    want = [(1, 5000, "response", None), (None, 5000, "revisit", 1), (1, 4000, "response", None), (1, 4000, "revisit", 1), (7, 4000, "revisit", 1)]
    want += [(None, 4000, "revisit", 1), (7, 0, "response", None), (7, 0, "revisit", 7), (None, 0, "revisit", 7)]
    assert rows == Counter(want)
    text = spark.createDataFrame([("a b/ü", "u", big), ("", "u", big)], "page_id string, url string, html string")
    assert {(r.page_id, r.refers_to) for r in warc.round_trip(text).collect()} == {("", None), ("a b/ü", "")}


def test_warc_payloads_come_back(spark, tmp_path):
    pages = [(1, "u", "a\r\n\r\nWARC/1.1\r\n"), (2, "v", "é" * 30_000)]
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "w"), params=warc.WarcParams(segment=777))
    back = {r.page: bytes(r.payload).decode() for r in warc.reassemble(warc.read_records(spark, str(tmp_path / "w"))).collect()}
    assert back == {str(i): h for i, _, h in pages}


@pytest.mark.parametrize("bad", [b"5\r\nab\r\n0\r\n\r\n", b"zz\r\n", b"5"])
def test_bad_chunks_are_refused(bad):
    with pytest.raises(warc.WarcError):
        warc.decode_chunked(bad)


def test_chunks_and_segments():
    payload = bytes(range(256)) * 40
    assert warc.decode_chunked(warc.encode_chunked(payload, 100)) == payload
    assert warc.decode_chunked(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"
    records = warc.response_records(1, 1, "u", payload, warc.digest(payload), warc.WarcParams(segment=1000))
    heads = [h for r in records for h, _ in warc.parse(r + b"\r\n")]
    assert [h["WARC-Segment-Number"] for h in heads] == [str(k + 1) for k in range(len(heads))]
    assert sum("WARC-Segment-Total-Length" in h for h in heads) == 1


def test_imatch_next_documents(docs, rows):
    got = {r.doc_id: r for r in imatch.compare_next(docs).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t, _) in enumerate(order):
        a, b = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        if edited == a:
            assert r.near_edited == 1.0
        assert 0 <= r.near_next <= 1
    for a, b in itertools.combinations(rows, 2):
        if (a[1] or "") == (b[1] or ""):
            assert got[a[0]].fingerprint == got[b[0]].fingerprint
    assert imatch.compare_next(docs.limit(0)).count() == 0
    one = imatch.compare_next(docs.filter("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_feistel_is_a_permutation(n):
    assert sorted(ordering.permute(np.arange(n), n, key=9)) == list(range(n))
    if n > 100:
        assert (ordering.permute(np.arange(n), n, key=9) != ordering.permute(np.arange(n), n, key=10)).any()


def test_shards_read_back_from_any_slot(spark, docs, rows, tmp_path):
    params = ordering.OrderParams(length=64, per_shard=16)
    index = ordering.materialise(docs, str(tmp_path / "s"), params=params).collect()
    n = len(index)
    assert sorted(r.slot for r in index) == list(range(n))
    crc = {r.slot: r.ids_crc32 for r in index}
    back = ordering.read_shards(spark, str(tmp_path / "s"), params, start_slot=n // 2).collect()
    assert {r.slot: zlib.crc32(r.ids) for r in back} == {s: c for s, c in crc.items() if s >= n // 2}
    e = packing.tokens.encoder(packing.tokens.default_path())
    assert sum(r.n_tokens for r in index) == sum(len(e.encode(t)) // 4 + 1 for _, t, _ in rows)
    assert {i for r in index for i in r.doc_ids} == {i for i, _, _ in rows}
    assert ordering.round_trip(docs.limit(0)).count() == 0


def page(body, extra=""):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav>{extra}<article><h1>Head</h1>{body}</article><footer>&copy; site</footer></body></html>'


def test_extraction(spark):
    pages = [(i, f"http://h{i % 2}.org/{i}", page(f"<p>Word{i} &amp; <b>bo</b>ld&nbsp;x<br>y<p>Next{i}", '<div class="cookie-notice">We use</div>')) for i in range(12)]
    pages += [(20, None, None), (21, "bad", ""), (22, "http://z/", "plain text"), (23, "http://z/", page("<p>cut off").split("</article>")[0])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("frame", F.lit(1))
    got = {r.page_id: r for r in templates.main_text(df).collect()}
    for i in range(12):
        assert got[i].text == f"Head Word{i} & bold x y Next{i}" and got[i].n_chars == len(got[i].text)
    assert [got[i].text for i in (20, 21, 22, 23)] == ["", "", "plain text", "Head cut off"]
    frames = {r.host: r.frame for r in templates.deduce(df, "url", "html").collect() if r.frame}
    assert set(frames) == {"h0.org", "h1.org"} and all(len(f) > 8 for f in frames.values())
    assert templates.main_text(df.limit(0)).count() == 0


def deduced(spark, pages):
    df = spark.createDataFrame([(i, "http://h.org/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in templates.main_text(df).orderBy("page_id").collect()]


def test_template_decides_where_markup_says_nothing(spark):
    """Neutral tags and class names: menu, advert, article and footer are all plain div elements."""
    rng = random.Random(31)
    pages, want = [], []
    for i in range(12):
        body = [prose(rng, rng.randrange(30, 90)) for _ in range(rng.randrange(2, 6))]
        menu = "".join(f"<div class=ke><a href=/{w}>{w}</a></div>" for w in (rng.choice(WORDS) + str(i) for _ in range(6)))
        pages.append(
            f"<body><div class=ka>{menu}</div><div class=kb>{prose(rng, 5)}</div><div class=kc><div class=kf>Share this page</div>"
            + "".join(f"<div class=kg>{x}</div>" for x in body)
            + f"</div><div class=kd>&copy; {prose(rng, 9)}</div></body>"
        )
        want.append(" ".join(body))
    assert deduced(spark, pages) == want
    assert deduced(spark, pages + ["", "<body>"])[:12] == want  # pages without tokens or text do not empty the frame


def test_template_narrows_and_yields_to_markup(spark):
    rng = random.Random(32)
    own = [prose(rng, 80) for _ in range(5)]
    wrap = "<body><div id=w><p>Subscribe now</p><article><p>{}</p><p>Read more below</p></article><div class=list>{}</div></div></body>"
    assert deduced(spark, [wrap.format(x, prose(rng, 20)) for x in own]) == own
    single = ["<body><article><h1>{}</h1><p>{}</p></article><div>{}</div></body>".format(x[:20], x, x[:9]) for x in own]
    assert deduced(spark, single) == [" ".join(f"{x[:20]} {x}".split()) for x in own]
    copies = ["<body><div id=a><p>The very same text on all pages</p></div></body>"] * 4
    assert deduced(spark, copies) == ["The very same text on all pages"] * 4


def test_article_keeps_what_only_sounds_like_a_notice():
    inner = '<div class="article-header"><h1>Head</h1></div><section class="related-work"><p title=it\'s>Kin</p></section><p class="ad">Buy<p>End<ul><li class=comment>no<li>yes</ul><span class="share">x <b>y</b></span>'
    assert templates.extract(f"<article>{inner}</article><p>don't</p>") == "Head Kin End yes"
    assert html.unescape("&eacute;") in templates.extract("<p>&eacute;</p>")


def test_extraction_defined_cases(spark):
    text = "<article><p>Some words of the page</p></article>"
    rows = [(None, "http://a/", text), (None, "http://a/", text), (4, None, text), (4, "http://a/", None), (4, "http://a/", "<p title='>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("rows", F.lit(2))
    got = templates.main_text(df).collect()
    assert Counter((r.page_id, r.text) for r in got) == Counter({(None, "Some words of the page"): 2, (4, "Some words of the page"): 1, (4, ""): 1, (4, "x"): 1})


def test_url_rules_match_brute_force(spark):
    hosts = ["net", "a.net", "example.net", "m.example.net", "notexample.net", "example.com", "x.example.com", "org", "b.org", "forg", ""]
    paths = ["", "/", "/en/", "/en", "/de/x", "/fr/?q", "/fr#a", "?x=/en/"]
    urls = [f"HTTP://{h.upper() if k % 2 else h}{p}" for h in hosts for k, p in enumerate(paths)] + [None, "", "no scheme", "://", "a://b://c/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").union(spark.createDataFrame([(0, urls[0])], "page_id long, url string"))
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "", "/de/x")]
    table = spark.createDataFrame(rules, "action string, host string, path string")
    got = url_rules.judge(df, table, ranges=5).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        u = urls[r.id]
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [(len(h) + len(p), len(h), h + p, a) for a, h, p in rules if (h in ("", host) or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits, default=(0, 0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, want[2], want[3]), u
    assert url_rules.judge(df.limit(0), table).count() == 0
