"""Facts of a place are dealt into parts of bounded size before they are grouped."""

from pyspark.sql import functions as F

from platlark.functions import shared
from platlark.plans import queries


def test_parts_follow_the_rows(spark):
    d = shared.dealt(spark.range(5000).select((F.col("id") % 1000).alias("k"), "id"), "k", rows=100)
    n = d.groupBy("k").count()
    assert d.rdd.getNumPartitions() == 50 and n.rdd.getNumPartitions() == 50
    assert {tuple(r) for r in n.collect()} == {(k, 5) for k in range(1000)}
    assert shared.dealt(spark.range(0).toDF("k"), "k").count() == 0


def test_scores_group_and_join_where_the_facts_were_dealt(spark, tmp_path):
    rows = [(k // 4, k % 9, k % 4 + 1, float(k % 7 + 1)) for k in range(400)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    scored = queries._scored(spark, str(tmp_path))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("REPARTITION_BY_NUM") == 2
    assert scored.count() == len({(a, b) for a, b, _c, _d in rows})


def test_rare_words_are_not_handed_on_and_arrays_meet_once(spark):
    """Words in buckets that no frequent word can be in stay in their task; the counts are those of all words."""
    from platlark.llm import collocations as C

    docs = spark.createDataFrame([("en", "sea salt. " * 30 + " ".join(f"rare{k}x{i}" for i in range(500))) for k in range(8)], "lang string, text string").repartition(4)
    params = C.PhraseParams(min_count=100, least_bits=16)
    chunks = C._chunks(docs, "text", "lang", params)
    assert C._full_words(chunks, params).size == 1 << 13 and bin(int.from_bytes(C._full_words(chunks, params).tobytes(), "little")).count("1") <= 4
    assert {tuple(r) for r in C._word_counts(chunks, params).collect()} == {("en", "sea", 240), ("en", "salt", 240), ("en", None, 4480)}
    sums = C._block_sums(spark.createDataFrame([(1, bytes(C._cells(C.np.arange(C.BLOCK)))), (1, bytes(C._cells(C.np.arange(C.BLOCK))))], C.BLOCKS), "sums")
    assert [(r.slot, r.f) for r in C._sums(sums, 8188).orderBy("slot").collect()] == [(2 * C.BLOCK - 2, 8188), (2 * C.BLOCK - 1, 8190)]
