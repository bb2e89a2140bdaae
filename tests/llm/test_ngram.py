import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import ngram


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40 - 1), max_size=300), st.sampled_from([2**40, 2**64]))
def test_elias_fano_round_trip(values, universe):
    v = np.array(sorted(values), np.uint64)
    (n, low_bytes), low, high = ngram.EliasFano.encode(v, universe)
    ef = ngram.EliasFano(int(n), int(low_bytes), low, high)
    assert (ef.access(np.arange(len(v))) == v).all()
    asked = np.concatenate((v, v + np.uint64(1), np.array([0, universe - 1], np.uint64)))
    at = ef.find(asked)
    known = set(values)
    for x, k in zip(asked.tolist(), at.tolist()):
        assert (k >= 0) == (x in known) and (k < 0 or v[k] == x)
    if len(v):
        first = ef.find(v, np.full(len(v), 1), np.full(len(v), len(v)))
        assert ((first >= 1) | (first == -1)).all()


def slow(train, docs):
    """Bigrams smoothed by add-one words, with a weight for contexts of as many bits of count, from plain dictionaries."""
    tok = lambda t: [w.decode("utf-8", "surrogatepass") for w in ngram.tokens_of(t)] + [" </s>"]
    uni, bi, n_docs = Counter(), Counter(), 0
    for t in train:
        w = tok(t)
        uni.update(w)
        bi.update(zip([" <s>"] + w[:-1], w))
        n_docs += 1
    n, v = sum(uni.values()), len(uni)
    total = lambda u: n_docs if u == " <s>" else uni[u]
    different, tokens = Counter(), Counter()
    for u, _ in bi:
        different[total(u).bit_length()] += 1
    for u in [*uni, " <s>"]:
        if u != " </s>":
            tokens[total(u).bit_length()] += total(u)
    weight = lambda c: min(ngram.DISCOUNT * different[c.bit_length()] / tokens[c.bit_length()], 0.999) if c else 1.0
    out = []
    for t in docs:
        base = score = 0.0
        w = tok(t)
        for u, x in zip([" <s>"] + w[:-1], w):
            p, c = (uni[x] + 1) / (n + v + 1), total(u)
            base += math.log10(p)
            score += math.log10((1 - weight(c)) * bi[u, x] / max(c, 1) + weight(c) * p)
        out.append((len(w), sum(uni[x] > 0 for x in w), n, base, score))
    return out


def check(spark, docs, scored):
    rows = docs.select("doc_id", "text").collect()
    held = lambda r: zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 7 == 2
    got = scored(docs).collect()
    want = slow([r.text for r in rows if not held(r)], [r.text for r in rows])
    key = lambda x: (str(x[0]), x[1][0], round(x[1][3], 3))
    assert all(r.held_out == held(r) for r in got)
    got = sorted(((r.doc_id, (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in got), key=key)
    want = sorted(zip([r.doc_id for r in rows], want), key=key)
    assert len(got) == len(want)
    for (d, g), (e, w) in zip(got, want):
        assert d == e and g[:3] == w[:3]
        assert g[3] == pytest.approx(w[3], rel=1e-9)
        assert g[4] == pytest.approx(w[4], rel=2e-3, abs=0.01)


def in_two(docs):
    from keelson.llm.common import fold_of

    return ngram.score(docs, ngram.train(docs.where(fold_of("doc_id", 7) != 2)))


@pytest.mark.parametrize("scored", [ngram.cross_scored, in_two])
def test_against_dictionaries(spark, sf, monkeypatch, scored):
    # many shards, and batches that the executors' workers make of few tokens
    monkeypatch.setattr(ngram, "WORD_BYTES", 60_000)
    monkeypatch.setattr(ngram, "PAIR_BYTES", 8_000)
    check(spark, spark.read.parquet(f"{sf}/documents.parquet").repartition(5, "doc_id"), scored)


@pytest.mark.parametrize("scored", [ngram.cross_scored, in_two])
def test_edges(spark, edge, scored):
    check(spark, edge, scored)


def test_nothing_to_learn_from(spark, edge, empty):
    model = ngram.train(empty)
    assert ngram.score(empty, model).count() == ngram.cross_scored(empty).count() == 0
    alone = ngram.score(edge.limit(3), model).collect()
    assert len(alone) == 3 and all(r.n_known == 0 and r.base_score == r.score == 0 for r in alone)


def test_batches_end_within_a_partition(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ngram, "HELD", 5)
    monkeypatch.setattr(ngram.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 3})()))
    texts = ["a b c", "d e", None, "f g h i j k", "l"]
    rows = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([False] * 5), pa.array([True] * 5), pa.array(texts)], names=["doc_id", "held_out", "learn", "text"])
    folder = f"file://{tmp_path}"
    got = [r for b in ngram.read_texts(iter([rows, rows.slice(0, 1)]), folder, 2) for r in b.to_pylist()]
    names = sorted({r["batch"] for r in got})
    assert names == ["3-0", "3-1", "3-2"]
    sizes, docs = [], []
    for name in names:
        size, _, _, doc = ngram.load_compressed(f"{folder}/batch-{name}")
        sizes.append(ngram.widen(size).tolist())
        docs.append(pa.ipc.open_stream(pa.py_buffer(doc)).read_all()["doc_id"].to_pylist())
    assert sizes == [[4, 3], [1, 7], [2, 4]] and docs == [[0, 1], [2, 3], [4, 0]]


def test_held_out_texts_score_above_the_base(spark):
    from keelson.llm.common import fold_of
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = ngram.score(docs, ngram.train(docs.where(fold_of("doc_id", 7) != 2))).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


def test_pairs_seen_once_are_known(spark):
    train = spark.createDataFrame([("a b c",), ("d e f",), ("a b",)], "text string")
    docs = spark.createDataFrame([(1, "d e f"), (2, "d c f")], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in ngram.score(docs, ngram.train(train)).collect()}
    # counts: 8 words and 3 ends; three rows begin. Contexts seen once (c, d, e, f) have 4 successors in 4 tokens,
    # those seen two or three times (a, b, and the begin) have 5 in 7; no pair is dropped
    uni, p = Counter({"a": 2, "b": 2, "c": 1, "d": 1, "e": 1, "f": 1, "</s>": 3}), lambda x: (uni[x] + 1) / 19
    once, more = ngram.DISCOUNT, ngram.DISCOUNT * 5 / 7
    want = math.log10((1 - more) / 3 + more * p("d")) + sum(math.log10(1 - once + once * p(x)) for x in ("e", "f", "</s>"))
    assert got[1] == pytest.approx(want, abs=0.01) and got[1] > got[2]


def test_numbers_come_back():
    for x in ([], [0], [255, 256, 3], [2**40, 1], list(range(70_000))):
        a = np.array(x, np.int64)
        assert (ngram.widen(ngram.squeeze(a)) == a).all()
