"""Links inside families of one template, and rows that share an id."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from platlark.llm import mixing, neardup, ordering, spans, url_rules


def family(rng, n, near, pair, words=190):
    """Pairs of alike texts in a family of one template: similarity ``pair`` inside a pair, ``near`` between pairs."""
    word = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    shared = word(round(words * 2 * near / (1 + near)))
    rows = []
    for i in range(0, n, 2):
        a = shared + word(words - len(shared))
        cut = round(words * (1 - pair) / (1 + pair))
        rows += [(i, " ".join(a)), (i + 1, " ".join(a[:-cut] + word(cut)))]
    return rows


@pytest.mark.parametrize(("near", "pair"), [(0.65, 0.85), (0.75, 0.82)])
def test_links_survive_in_a_dense_family(spark, near, pair):
    n = 800
    docs = spark.createDataFrame(family(random.Random(3), n, near, pair), "doc_id long, text string")
    kept = {r.doc_id for r in neardup.deduplicate(docs).select("doc_id").collect()}
    assert all(i in kept for i in range(0, n, 2))
    assert sum(i + 1 not in kept for i in range(0, n, 2)) >= 0.95 * n / 2


def test_alike_pairs_match_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint32)) for _ in range(40)]
    q, j = np.triu_indices(40, 1)
    got = neardup.alike_pairs([s.tobytes() for s in sets], q, j, 0.5)
    want = []
    for a, b in zip(q, j, strict=True):
        x, y = set(sets[a].tolist()), set(sets[b].tolist())
        want.append(len(x & y) >= 0.5 * len(x | y))
    assert got.tolist() == want


P = "The first of all sentences stands here. A second one comes after it. And the third ends the text."
Q = "Nothing of this stands anywhere else. It is a text of its own. No sentence of it is known."


def test_rows_of_one_id_keep_their_own_text(spark):
    rows = [(1, P), (5, P), (5, Q), (5, Q), (None, P), (None, Q), (7, "One two. Three four. Five six."), (8, "One two. Three four. Five six.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"places": F.lit("mine"), "th": F.lit(1), "id": F.lit(2)})
    out = spans.remove_repeats(docs)
    got = sorted(((r.doc_id or 0, r.text, r.n_removed) for r in out.collect()), key=repr)
    assert got == sorted([(1, P, 0), (5, "", 3), (5, Q, 0), (5, Q, 0), (0, P, 0), (0, Q, 0), (7, rows[6][1], 0), (8, "", 3)], key=repr)
    assert out.columns == ["doc_id", "text", "places", "th", "id", "n_sentences", "n_removed"]


def test_texts_without_ids_are_drawn_apart(spark):
    rows = [(None, f"text number {k} of a source", "a") for k in range(400)] + [(1, "x" * 9000, "b")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights={"a": 0.5, "b": 0.5}, epochs=0.2)
    copies = {r.text: r["count"] for r in out.filter("source = 'a'").groupBy("text").count().collect()}
    assert 0 < len(copies) < 400 and len(set(copies.values())) > 1
    assert out.select("shuffle_key").distinct().count() == out.count()


@pytest.mark.parametrize("kind", ["decimal(20,2)", "smallint", "date", "double", "string", "int"])
def test_url_rules_take_ids_of_any_type(spark, kind):
    made = "date_add(date'2024-01-01', cast(id as int))" if kind == "date" else f"cast(id as {kind})"
    pages = spark.range(40).selectExpr(f"case when id % 7 <> 0 then {made} end as page_id", "concat('http://a', id, if(id % 2 = 0, '.net/x', '.org/fr/x')) as url")
    rules = spark.createDataFrame([("block", "net", "/"), ("allow", "org", "/fr/")], "action string, host string, path string")
    out = url_rules.judge(pages, rules)
    assert out.schema["id"].dataType == pages.schema["page_id"].dataType
    assert sorted((str(r.id), r.verdict) for r in out.collect()) == sorted(
        (str(r.page_id), "block" if ".net" in r.url else "allow") for r in pages.collect()
    )


def test_a_resumed_read_opens_no_earlier_shard(spark, tmp_path):
    params = ordering.OrderParams(length=16, per_shard=4)
    docs = spark.createDataFrame([(k, f"document number {k} with some words in it " * 6) for k in range(30)], "doc_id long, text string")
    path = str(tmp_path / "shards")
    ordering.materialise(docs, path, params=params)
    whole = {r.slot: bytes(r.ids) for r in ordering.read_shards(spark, path, params).collect()}
    first = next((tmp_path / "shards" / "shard=0").glob("part-*"))
    with open(first, "wb") as poison:  # longer than a binary file may be
        poison.truncate(5000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "4000")
    try:
        rest = {r.slot: bytes(r.ids) for r in ordering.read_shards(spark, path, params, start_slot=6).collect()}
        assert rest == {k: v for k, v in whole.items() if k >= 6}
        with pytest.raises(Exception, match="maxLength|exceeds|5000"):
            ordering.read_shards(spark, path, params, start_slot=3).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


@pytest.mark.parametrize("with_sets", [False, True])
def test_no_near_pair_of_an_overfull_node_is_lost(spark, with_sets):
    """3,000 codes of one node, cut by blocks and by partitions: one table joins all that links of the node join."""
    rng = np.random.default_rng(3)
    bits = neardup.orders(1)[0]
    flat = np.zeros((3000, neardup.BITS), np.uint8)
    flat[:, bits[8:30]] = (rng.choice(1 << 22, 3000, replace=False)[:, None] >> np.arange(22)) & 1
    lanes = np.packbits(flat, axis=1)
    rows = [(k, c.tobytes(), np.array([k // 2], np.uint32).tobytes()) for k, c in enumerate(lanes)]
    d = spark.createDataFrame(rows, "node long, code binary, s binary")
    apart = np.bitwise_count(lanes.view(np.uint64)[:, None] ^ lanes.view(np.uint64)[None]).sum(axis=2)
    near = apart <= 3
    if with_sets:  # only the rows 2k and 2k + 1 are alike
        near = (apart <= 20) & (np.arange(3000)[:, None] // 2 == np.arange(3000)[None] // 2)
    want, have = np.arange(3000), np.arange(3000)
    q, j = np.nonzero(np.triu(near, 1))
    found = neardup._near_in_tables(d, 20, 8, 1, 0.8, 7) if with_sets else neardup.candidates(d.drop("s"), 3, 8, 1)
    got = [(r.src, r.dst) for r in found.collect()]
    assert all(near[a, b] and a < b for a, b in got) and len(set(got)) == len(got)
    for label, pairs in ((want, zip(q.tolist(), j.tolist())), (have, got)):
        find = lambda x: x if label[x] == x else find(label[x])  # noqa: E731, B023
        for a, b in pairs:
            a, b = find(a), find(b)
            label[max(a, b)] = min(a, b)
        for x in range(3000):
            label[x] = find(x)
    assert len(np.unique(want)) < 3000 and (want == have).all()
