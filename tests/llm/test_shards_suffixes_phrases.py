"""Retention shards, suffix dedup and collocations against plain versions written for the test alone, on awkward rows."""

import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from platlark.llm import collocations as C, retention as R, suffix_dedup as S

EPOCH = datetime(1970, 1, 1)
WEEK = timedelta(days=7)


# ---- retention -------------------------------------------------------------

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, hot string"
CLIENTS = "client_id long, source string, segment string"


def crc(n):
    return zlib.crc32(str(n).encode())


def plain_retention(clicks, clients):
    own = {}
    for c, s, _ in clients:
        if c is not None and s is not None:
            own[c] = min(own.get(c, s), s)
    seen = defaultdict(list)
    for click, ts, arrived, client, kind, value, _ in dict.fromkeys(clicks):
        if ts is None or client is None:
            continue
        late = timedelta(days=crc(click) % 100) if click is not None and crc(click) % 3 == 0 else timedelta()
        early = arrived is not None and arrived + late < datetime(2024, 2, 1)
        cents = int(np.floor(value * 100 + 0.5)) if value is not None and np.isfinite(value) else 0
        seen[client].append((ts, early, kind == "error", cents))
    cells = defaultdict(lambda: [0, 0, 0, 0])
    for client, rows in seen.items():
        starts = [min((t for t, early, opens, _ in rows if opens and (early or state)), default=None) for state in (0, 1)]
        weeks = [None if s is None else (s - EPOCH) // WEEK for s in starts]
        moved = None not in weeks and weeks[0] != weeks[1]
        for state in (0, 1):
            if starts[state] is None:
                continue
            periods = defaultdict(int)
            for t, early, _, cents in rows:
                if (early or state) and t >= starts[state]:
                    periods[(t - starts[state]) // WEEK] += cents
            for period, cents in periods.items():
                cell = cells[state, own.get(client, ""), weeks[state], period]
                for i, v in enumerate((1, crc(client), int(moved), cents)):
                    cell[i] += v
    return {k: tuple(v) for k, v in cells.items()}


def retained(spark, clicks, clients, params=R.RetentionParams()):
    rows = R.retention(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(clients, CLIENTS), params).collect()
    return {(r.state, r.segment, r.cohort, r.period): (r.users, r.users_crc32, r.moved, r.cents) for r in rows}


@pytest.fixture(scope="module")
def shop():
    rng = random.Random(5)
    clicks = []
    for i in range(1500):
        client = None if rng.random() < 0.03 else 7 if rng.random() < 0.4 else rng.randrange(40)
        ts = None if rng.random() < 0.03 else datetime(2023, 12, 20) + timedelta(microseconds=rng.randrange(90 * 86_400_000_000))
        arrived = None if ts is None or rng.random() < 0.05 else ts + timedelta(hours=rng.randrange(200))
        value = rng.choice([None, 0.125, -3.005, 99.99, float("nan"), float("inf")])
        clicks.append((rng.choice([None, i, i // 2]), ts, arrived, client, rng.choice(["view", "error", None]), value, rng.choice(["a", None])))
    clicks += rng.sample(clicks, 200)
    clients = [(i, rng.choice(["web", "crm", None]), "x") for i in range(30)] + [(3, "app", None), (3, "zoo", None), (None, "web", "y")]
    return clicks, clients


def nanless(rows):
    """Equal rows hold equal keys: not-a-number becomes one value."""
    return [tuple("nan" if isinstance(x, float) and x != x else x for x in r) for r in rows]


def test_retention_matches_plain_version(spark, shop):
    clicks, clients = shop
    want = plain_retention([tuple(None if x == "nan" else x for x in r) for r in dict.fromkeys(nanless(clicks))], clients)
    assert retained(spark, clicks, clients) == want


@pytest.mark.parametrize("share", [1, 10])
def test_retention_is_the_same_whoever_counts_as_hot(spark, shop, share):
    clicks, clients = shop
    few = R.RetentionParams(hot_share=share, bucket_rows=100, memory_mb=64)
    assert retained(spark, clicks, clients, few) == retained(spark, clicks, clients)


def test_retention_of_empty_tables(spark, shop):
    clicks, clients = shop
    assert retained(spark, [], []) == {}
    assert retained(spark, [], clients) == {}
    assert {k[1] for k in retained(spark, clicks, [])} == {""}


# ---- suffix dedup ----------------------------------------------------------


def plain_removed(rows, m):
    """(id, text) rows -> removed spans and kept bytes of each."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - m + 1 if i is not None else 0):
            w = b[k : k + m]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - m + 1 if i is not None else 0):
            if first[b[k : k + m]] < i:
                gone[k + 1 : k + m + 1] = True
        edges = np.flatnonzero(np.diff(gone.astype(np.int8)))
        out.append((i, len(b), tuple(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), bytes(np.frombuffer(b, np.uint8)[~gone[1 : len(b) + 1]])))
    return Counter(out)


def removed(spark, rows, params):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, block string, part int")
    return Counter((r.id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in S.remove_repeats(docs, params=params).collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(30, 160))) for _ in range(12)]
    line = "all rights are kept by nobody in particular here"
    rows = [(None, pool[0]), (None, pool[1]), (4, None), (5, ""), (9, pool[0]), (9, pool[0]), (9, pool[2] + pool[0]), (2, "=" * 400), (3, "-" + "=" * 300)]
    for i in range(60):
        parts = [rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choice("vwxyz ü") for _ in range(rng.randrange(5, 90))) for _ in range(rng.randrange(1, 4))]
        t = "".join(parts) + line + "".join(rng.choice("klmno") for _ in range(20))
        k = rng.randrange(len(t))
        rows.append((rng.randrange(100), t[:k] + "#" + t[k + 1 :] if rng.random() < 0.4 else t))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "params",
    [
        S.SuffixParams(),
        S.SuffixParams(block_bytes=2000, group_blocks=2, collection=10),
        S.SuffixParams(block_bytes=3000, crowd=0),
        S.SuffixParams(match=40, anchor=12, block_bytes=2500, crowd=3, sample_blocks=2),
    ],
)
def test_suffix_dedup_matches_all_substrings(spark, texts, params):
    assert removed(spark, texts, params) == plain_removed(texts, params.match)


def test_suffix_dedup_of_an_empty_table(spark):
    assert removed(spark, [], S.SuffixParams()) == Counter()


def test_collection_finds_earlier_windows():
    rng = random.Random(1)
    step = S.Collection.STEP
    try:
        for _ in range(25):
            m, S.Collection.STEP = rng.choice([4, 8, 50]), rng.choice([7, 64, 1 << 18])
            base = bytes(rng.choice(b"ab" if m < 50 else b"abc") for _ in range(300))
            strings = []
            for _ in range(rng.randrange(1, 60)):
                size = m + rng.randrange(0, S.WINDOWS)
                at = rng.randrange(300 - size)
                s = bytearray(base[at : at + size])
                if rng.random() < 0.5:
                    s[rng.randrange(size)] = 120
                strings.append(bytes(s))
            ids = [rng.randrange(10) for _ in strings]
            first: dict[bytes, int] = {}
            for s, i in zip(strings, ids, strict=True):
                for k in range(len(s) - m + 1):
                    first[s[k : k + m]] = min(first.get(s[k : k + m], i), i)
            want = [sum(1 << k for k in range(len(s) - m + 1) if first[s[k : k + m]] < i) for s, i in zip(strings, ids, strict=True)]
            lines = np.zeros((len(strings), S.WINDOWS + m - 1), np.uint8)
            for row, s in zip(lines, strings, strict=True):
                row[-len(s) :] = np.frombuffer(s, np.uint8) + 1
            assert S._compared(lines, np.array([len(s) for s in strings]), np.array(ids), m).tolist() == want
    finally:
        S.Collection.STEP = step


# ---- collocations ----------------------------------------------------------


def plain_phrases(rows, p):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, p.longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        found = {t: a for t, a in counts.items() if len(t) > 1 and a >= p.min_count}
        rows = []
        for t, a in found.items():
            longer = [b for u, b in found.items() if len(u) > len(t) and any(u[i : i + len(t)] == t for i in range(len(u)))]
            if any(100 * b >= p.contained_percent * a for b in longer):
                continue
            cut = min((1000 * a * n[lang] // (counts[t[:k]] * counts[t[k:]]), k) for k in range(1, len(t)))
            rows.append((-cut[0], -a, " ".join(t).encode(), counts[t[: cut[1]]], counts[t[cut[1] :]]))
        out |= {(lang, i + 1, r[2].decode(), -r[1], r[3], r[4], n[lang], -r[0]) for i, r in enumerate(sorted(rows)[: p.top])}
    return out


def phrases(spark, rows, params):
    docs = spark.createDataFrame([(lang, t, 1, "w") for lang, t in rows], "lang string, text string, n int, word string")
    return {tuple(r) for r in C.collocations(docs, params=params).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    words = ["The", "sea", "ÉTÉ", "été", "a", "b c", "x\x00y", "new", "york", "Times"]
    rows = [(None, None), ("en", ""), ("", "the sea. the sea"), ("en", " ,.; ")]
    for _ in range(80):
        parts = []
        for _ in range(rng.randrange(1, 30)):
            parts.append(rng.choice(words) if rng.random() < 0.6 else "new york times")
            parts.append(rng.choice([" ", "  ", "\t", ". ", "\n", "! ", " "]))
        rows.append((rng.choice(["en", "en", None, "fr"]), "".join(parts)))
    return rows + rows[:20]


@pytest.mark.parametrize(
    "params",
    [
        C.PhraseParams(min_count=4),
        C.PhraseParams(min_count=6, longest=4, top=7, contained_percent=60, chunk_words=50),
        C.PhraseParams(min_count=12, longest=3, slice_keys=40, bucket_bits=12, least_bits=13, chunk_words=300),
    ],
)
def test_collocations_match_plain_version(spark, corpus, params):
    assert phrases(spark, corpus, params) == plain_phrases(corpus, params)


def test_collocations_of_tables_without_phrases(spark):
    assert phrases(spark, [], C.PhraseParams(min_count=2)) == set()
    assert phrases(spark, [("en", "one two"), (None, None)], C.PhraseParams(min_count=2)) == set()


def test_texts_are_cut_where_pieces_end(monkeypatch):
    monkeypatch.setattr(C, "STRETCH", 8)
    text = b"abc def.gh.ijklmnopqrstuv wxyz.a.b."
    assert b"".join(C._stretches(text)) == text
    assert all(x.endswith(b".") for x in list(C._stretches(text))[:-1])


def test_buckets_beyond_a_slice_are_dealt():
    buckets = C._Buckets.of(10**6, C.PhraseParams(bucket_bits=14, least_bits=12, bucket_words=6))
    assert buckets.bits == 14 and buckets.slices == 16
    keys = np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64)
    parts = [buckets.own(keys, k)[0] for k in range(buckets.slices)]
    assert sorted(np.concatenate(parts).tolist()) == list(range(5000))


def test_perfect_hash_numbers_keys_and_knows_strangers():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        index = C.KeyIndex(keys, 10)
        assert sorted((index.ids(keys) - 10).tolist()) == list(range(len(keys)))
        assert (index.ids(keys + np.uint64(2**63)) == -1).all()
    names = [f"w{i}".encode() for i in range(500)]
    words = C.WordIndex(names, 0)
    assert sorted(words.ids(names).tolist()) == list(range(500))
    assert words.ids([b"other", b""]).tolist() == [-1, -1]
    with pytest.raises(ValueError):
        C.PerfectHash(np.array([5, 5], np.uint64))
