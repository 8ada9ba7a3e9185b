"""Each operator that SQL cannot express, and the whole pipeline, against a plain version written for the test alone."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from platlark.llm import imatch, mixing, native_quality as Q, ordering, packing, spans, tokens, url_rules

WORDS = [a + b for a in ("ba", "do", "ki", "lu", "mer", "no") for b in ("ra", "ten", "sil", "vo", "quin")]


def prose(rng, n):
    out = []
    while n > 0:
        k = min(n, rng.randrange(6, 12))
        out.append(" ".join(rng.choice(WORDS) for _ in range(k)).capitalize() + ".")
        n -= k
    return " ".join(out)


def split_words(text):
    return [w for w in re.split(r"[ \t\n\x0b\x0c\r]", text or "") if w]


# ---- quality rules ---------------------------------------------------------


def hashes(text):
    """Hashes of the words and of each two neighbours, as Spark's xxhash64 gives them."""
    one = [xxhash.xxh64_intdigest(w.encode(), 42) for w in split_words(text)]
    le = lambda x: x.to_bytes(8, "little")
    return one, [xxhash.xxh64_intdigest(le(b), xxhash.xxh64_intdigest(le(a), 42)) for a, b in itertools.pairwise(one)]


def quality(rows, trusted, params=Q.QualityParams()):
    """id -> (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr); rows: (id, text)."""
    raw, target = Counter(), Counter()
    for i, t in rows:
        own = Counter(h % params.buckets for part in hashes(t) for h in part)
        raw += own
        if i in trusted:
            target += own
    share = target.total() / raw.total() if raw else 0
    ratio = {b: math.log((target[b] + params.smoothing) / (n * share + params.smoothing)) if target else 0.0 for b, n in raw.items()}
    out = {}
    for i, t in rows:
        w, one_two = split_words(t), hashes(t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if split_words(x)]
        n = sum(map(len, one_two))
        llr = sum(ratio[h % params.buckets] for part in one_two for h in part) / n if n else 0.0
        failed = len(w) < params.min_words or 100 * len(covered) > params.max_repeat_percent * len(w)
        symbols = sum((t or "").count(c) for c in "#*$%&|<>")
        out[i] = (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed, not failed and llr >= params.threshold, llr)
    return out


def quality_rows():
    rng = random.Random(2)
    good = [prose(rng, rng.randrange(40, 160)) for _ in range(40)]
    junk = [" ".join(rng.choice("$#%&") * 3 + rng.choice(WORDS[:4]) for _ in range(90)) for _ in range(20)]
    odd = [None, "", " \n\t\x0b ", "one", "a b " * 60, "a line\na line\n\n \nb\x0cline\na line", "x\x0by z " * 20 + prose(rng, 80), "<b> # " + prose(rng, 60), "é\xa0é " * 60]
    return list(enumerate(good + junk + odd))


def test_quality_against_brute_force(spark):
    rows = quality_rows()
    want = quality(rows, set(range(25)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in Q.quality(df, df.filter("doc_id < 25").select("doc_id")).collect()}
    assert len(got) == len(rows) and {w[6] for w in want.values()} == {True, False}
    for i, w in want.items():
        assert tuple(got[i])[1:8] == w[:7], i
        assert got[i].llr == pytest.approx(w[7], abs=1e-9)


# ---- document fingerprints -------------------------------------------------


def imatch_terms(text):
    return {xxhash.xxh64_intdigest(w, 7) for w in text.encode().lower().split()}


def kept_by(term, k):
    """Whether subset ``k`` holds a term."""
    m = (1 << 64) - 1
    x = ((term ^ (0x9E3779B97F4A7C15 * (k + 1) & m)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ x >> 29) * 0x94D049BB133111EB) & m
    return (x >> 40) % 2 ** imatch.RATES[k] == 0


def imatch_print(text, lexicon):
    terms = imatch_terms(text) & lexicon or imatch_terms(text)
    out = ""
    for k in range(len(imatch.RATES)):
        inside = b"".join(t.to_bytes(8, "little") for t in sorted(terms) if kept_by(t, k))
        out += f"{xxhash.xxh64_intdigest(inside) & 0xFFFF:04x}" if inside else "----"
    return out


def imatch_like(a, b):
    pairs = [(a[i : i + 4], b[i : i + 4]) for i in range(0, len(a), 4)]
    pairs = [p for p in pairs if p != ("----", "----")]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0


def test_imatch_against_brute_force(spark):
    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(5, 120)) + f" own{i} rare{i // 2} band{i % 9}" for i in range(50)] + [None, "", " \n", "É one", prose(rng, 3000)]
    rows = list(enumerate(texts))
    params = imatch.MatchParams(low=0.03, high=0.5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("part", F.lit("x")).withColumn("id", F.lit(1))
    got = {r.doc_id: r for r in imatch.compare_next(df, params=params).collect()}
    df_of = Counter(t for x in texts for t in imatch_terms(x or ""))
    lexicon = {t for t, n in df_of.items() if max(2, 0.03 * len(rows)) <= n <= max(2, 0.5 * len(rows))}
    assert lexicon and len(lexicon) < len(df_of)
    order = sorted(rows, reverse=True)
    for (i, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
        a, b = a or "", b or ""
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        prints = [imatch_print(x, lexicon) for x in (a, edited, b)]
        want = (len(a), hashlib.sha256(edited.encode()).hexdigest(), *prints[:2], imatch_like(prints[0], prints[1]), imatch_like(prints[0], prints[2]))
        assert tuple(got[i])[1:] == pytest.approx(want), i


def test_imatch_null_and_repeated_ids(spark):
    rows = [(None, "a b"), (None, None), (3, "a b"), (3, "c"), (3, "c"), (9, "x")]
    got = imatch.compare_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    assert len({r.fingerprint for r in got if r.n_chars == 3}) == 1


# ---- training order --------------------------------------------------------


@pytest.mark.parametrize("per_shard", [4, 1000])
def test_training_order_against_brute_force(spark, tmp_path, per_shard):
    rng = random.Random(3)
    rows = [(1, None), (None, prose(rng, 90)), (2, prose(rng, 300)), (2, prose(rng, 300)), (2, ""), (5, "tail")] + [(10 + k, prose(rng, 20)) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn("slot", F.lit("x")).withColumn("data", F.lit(1))
    params = ordering.OrderParams(length=64, per_shard=per_shard, bundle=7)
    index = {r.sequence_id: r for r in ordering.materialise(df, str(tmp_path / "s"), params=params).collect()}
    tok = tokens.encoder(tokens.default_path()).tokenizer
    flat = [x for _, t in rows for x in [*tok.encode(t or "", add_special_tokens=False).ids, 0]]
    owner = [i for i, t in rows for _ in range(len(tok.encode(t or "", add_special_tokens=False).ids) + 1)]
    n = -(-len(flat) // 64)
    slots = ordering.permute(np.arange(n), n, params.key).tolist()
    disk = {}
    for k in range(n):
        ids = flat[64 * k : 64 * k + 64]
        whole = np.array(ids + [0] * (64 - len(ids)), dtype="<u2").tobytes()
        disk[slots[k]] = whole
        r = index[k]
        assert (r.slot, r.n_tokens, r.ids_crc32, r.shard) == (slots[k], len(ids), zlib.crc32(whole), slots[k] // per_shard)
        assert r.doc_ids == list(dict.fromkeys(i for i in owner[64 * k : 64 * k + 64] if i is not None))
    assert sorted(index) == list(range(n)) and sorted(slots) == list(range(n))
    for shard in range(-(-n // per_shard)):
        (file,) = (tmp_path / "s" / f"shard={shard}").glob("part-*")
        held = file.read_bytes()
        assert held == b"".join(disk[s] for s in range(shard * per_shard, min(n, (shard + 1) * per_shard))) + b"\n"


def test_ids_over_two_bytes_are_refused():
    assert ordering.two_bytes(np.array([0, 65_535], dtype="<u4")).max() == 65_535
    with pytest.raises(ValueError, match="70000"):
        ordering.two_bytes(np.array([3, 70_000], dtype="<u4"))


# ---- mixing and url rules: the cases that SQL does not hold ----------------


def poisson(doc_id, mean, seed=42):
    draws = max(1, math.ceil(mean / mixing.STEP))
    cdf, p, c = [], math.exp(-mean / draws), 0.0
    for k in range(mixing.TERMS):
        p = p * (mean / draws) / k if k else p
        c += p
        cdf.append(c)
    name = "" if doc_id is None else str(doc_id)
    at = [int(hashlib.md5(f"{name}:{seed}:{j}".encode()).hexdigest()[:13], 16) / 2**52 for j in range(1, draws + 1)]
    return sum(sum(x <= u for x in cdf) for u in at)


def source_rates(rows):
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t or "")
    goal = sum(v**0.5 for v in size.values())
    return {s: v**0.5 / goal * sum(size.values()) / v if v else 1.0 for s, v in size.items()}


@pytest.mark.parametrize("few", [5000, 1])
def test_mixing_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW", few)
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(1, 60)), ["a", "b", None, "c"][min(3, i % 7)]) for i in range(300)]
    rows += [(None, "no id", "a"), (None, "none either", "b"), (400, None, "empty"), (401, "", "empty"), (7, "again", "c"), (7, "again", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = Counter((r.doc_id, r.text, r.source) for r in mixing.mix(df).collect())
    rates = source_rates(rows)
    want = Counter()
    for i, t, s in rows:
        want[i, t, s] += poisson(i, rates[s])
    assert got == +want


def test_url_rules_with_null_parts(spark):
    df = spark.createDataFrame([(None, None), (None, "http://a.net/x"), (1, "http://a.net/x")], "page_id long, url string").withColumn("host", F.lit(1))
    rules = spark.createDataFrame([("block", "net", "/"), ("allow", None, "/x"), ("block", "a.net", None)], "action string, host string, path string")
    got = url_rules.judge(df, rules).collect()
    assert sorted((r.host, r.path) for r in got) == [("", ""), ("a.net", "/x"), ("a.net", "/x")] and all(r.verdict in ("allow", "block") for r in got)


# ---- the pipeline ----------------------------------------------------------


def near_dedup(rows):
    """The row of the smallest id of each group of five-word similarity 0.8 or more."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for _, t, _ in rows:
        w = split_words(lower(t))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    return [r for k, r in enumerate(rows) if root[k] == k]


def cut_sentences(text):
    """[start, end, start of the next]: a sentence ends after . ! ? before white space, and at line ends."""
    out, start, i, n = [], 0, 0, len(text)
    while i < n:
        if text[i] == "\n" or (text[i] in " \t\r\f\v" and i and text[i - 1] in ".!?"):
            j = i
            while j < n and (text[j] in " \t\r\f\v\n" if text[i - 1 : i] in (".", "!", "?") and i else text[j] == "\n"):
                j += 1
            if i > start:
                out.append([start, i, j])
            elif out:
                out[-1][2] = j
            start = i = j
        else:
            i += 1
    return out + [[start, n, n]] * (start < n)


def span_dedup(rows):
    seen, gone = {}, {}
    for i, t, _ in sorted(rows):
        parts = [tuple(t[a:b].lower().split()) for a, b, _ in cut_sentences(t or "")]
        for at in range(len(parts)):
            for size, least in spans.RUNS.items():
                run = parts[at : at + size]
                if len(run) == size and sum(map(len, run)) >= least:
                    seen.setdefault((size, *run), []).append((i, at * 4 + size))
    for places in seen.values():
        for i, p in places:
            if (i, p) != min(places):
                gone.setdefault(i, set()).update(range(p // 4, p // 4 + p % 4))
    out = []
    for i, t, s in rows:
        drop = gone.get(i, set())
        cuts = cut_sentences(t or "")
        keep = "".join("" if k in drop else t[a:z] for k, (a, _, z) in enumerate(cuts))
        out.append((i, (t[: cuts[0][0]] + keep) if cuts else t, s))
    return out


def test_span_dedup_against_brute_force(spark):
    rng = random.Random(14)
    passages = [prose(rng, 60) for _ in range(3)]
    rows = [(i, "\n".join([prose(rng, 30), passages[i % 3] if i % 2 else "Short. Bits!  And?\n\n", prose(rng, 20)]), "s") for i in range(30)]
    rows += [(90, "\n\n  lead. " + passages[0], "s"), (91, "", "s"), (92, None, "s"), (93, passages[1] + " " + passages[1], "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r.doc_id: r.text for r in spans.remove_repeats(df).collect()}
    assert got == {i: t for i, t, _ in span_dedup(rows)}


def test_pipeline_against_brute_force(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(17)
    base = [prose(rng, rng.randrange(60, 250)) for _ in range(60)]
    passage = prose(rng, 70)
    near = [b.replace(b.split()[20], "changed", 1) for b in base[:10]]
    texts = base + near + base[:5] + [prose(rng, 60) + "\n" + passage + "\n" + prose(rng, 60) for _ in range(6)]
    texts += [" ".join(rng.choice("$#%&") * 3 + rng.choice(WORDS[:4]) for _ in range(90)) for _ in range(15)] + [None, "", "too short", prose(rng, 4000)]
    rows = [(i, t, "abc"[min(2, i % 5)]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    verdict = quality([(i, t) for i, t, _ in rows], set(range(40)))
    kept = near_dedup([r for r in rows if verdict[r[0]][6]])
    assert 60 <= len(kept) < len(rows) - 20
    kept = span_dedup(kept)
    rates = source_rates(kept)
    want = Counter()
    tok = tokens.encoder(tokens.default_path()).tokenizer
    for i, t, s in kept:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, z) in enumerate(itertools.pairwise(cuts)):
            want[i, k, a, z - a, zlib.crc32(ids[a:z].tobytes())] += poisson(i, rates[s])
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    least = -(-sum(r.length for r in got) // 2048)
    assert all(o == sum(n for _, n in sorted(b)[:k]) for b in bins.values() for k, (o, _) in enumerate(sorted(b)))
    assert all(sum(n for _, n in b) <= 2048 for b in bins.values()) and len(bins) <= 1.02 * least + 1


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, copy string, n_removed string"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    long = " ".join(f"w{k}" for k in range(80))
    odd = [(None, long, None, None, None), (None, None, "en", None, 0), (1, long, "en", "s", 1), (1, long, "en", "s", 1), (1, "other " + long[::-1], None, "s", None)]
    odd = [(*r, "own", "mine") for r in odd]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
                assert {(r.copy, r.n_removed) for r in docs.select("copy", "n_removed").collect()} <= {("own", "mine")}, name
        assert (docs.count() > 0) == bool(rows)
