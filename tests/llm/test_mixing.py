from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keelson.llm import mixing


def slow_targets(sizes):
    """Shares by weight, the excess over twice a source's size shared again among the rest until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, capped, total = {}, set(), 1.5 * sum(sizes.values())
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: 2.0 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def check(docs):
    rows = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for r in docs.select("doc_id", "text", "source").collect():
        sizes[r.source] += len((r.text or "").encode().split())
    assert len(rows) == docs.count()
    target, taken, biggest = slow_targets(sizes), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], abs=1e-6)
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
        if r.size:
            assert abs(r.copies - r.target / r.source_size) < 1
        taken[r.source] += r.taken
        biggest[r.source] = max(biggest[r.source], r.size)
    for s in sizes:  # off by the last fraction only
        assert abs(taken[s] - target[s]) <= biggest[s]
    return rows


def test_small_table_and_reruns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = check(docs)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_edges(edge, empty):
    check(edge)
    assert mixing.mix(empty).count() == 0
    check(edge.where("text is null or trim(text) = ''"))


def test_one_source_and_one_id_hold_most_rows(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 3 * 5 as int))").alias("text"), F.when(F.col("id") < 2500, "big").otherwise("small").alias("source"))
    check(docs)


def test_each_document_keeps_its_expectation(spark):
    # the mean of copies over many like documents is near the source's rate
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 40 as int))").alias("text"), F.expr("array('a', 'b', 'c')[id % 3]").alias("source"))
    got = mixing.mix(docs).groupBy("source").agg(F.avg("copies").alias("c"), F.first("target").alias("t"), F.first("source_size").alias("s")).collect()
    for r in got:
        assert r.c == pytest.approx(r.t / r.s, abs=0.08)


def test_word_count(spark):
    texts = ["", None, " a\tb\x0bc\x0cd\re\nf ", " ", " x y", "a\x1cb", "  "]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.word_count("text").alias("n")).collect()
    assert [r.n for r in got] == [0, 0, 6, 1, 2, 1, 0]
