import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import langid, quality


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_edges(spark, sf, edge, empty):
    got = {r.doc_id: r for r in langid.identify(edge).collect() if r.doc_id is not None}
    assert {got[i].lang_pred for i in (0, 1, 2, 4, 8, 9)} == {"und"} and got[0].score == 0
    assert got[3].lang_pred == "en" and len(langid.identify(edge).collect()) == edge.count()
    assert langid.identify(empty).count() == 0
    untaught = edge.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(untaught).collect()} == {"und"}


def slow_model(rows):
    """Log frequencies of a word by language, from plain dictionaries of strings."""
    counts = defaultdict(Counter)
    for lang, text in rows:
        for w in langid.words_of(text):
            counts[lang, 0][w] += 1
            b = f"<{w}>"
            for n in range(1, langid.LONGEST + 1):
                counts[lang, n].update(b[i : i + n] for i in range(len(b) - n + 1))
    langs = sorted({lang for lang, _ in counts})
    known = [set().union(*(counts[lang, n] for lang in langs)) for n in range(langid.LONGEST + 1)]
    log = lambda lang, n, g: math.log((counts[lang, n][g] + 0.5) / (sum(counts[lang, n].values()) + 0.5 * len(known[n]) + 1))

    def row(word):
        if word in known[0]:
            return [log(lang, 0, word) for lang in langs]
        b = f"<{word}>"
        for n in range(langid.LONGEST, 0, -1):
            grams = [g for g in (b[i : i + n] for i in range(len(b) - n + 1)) if g in known[n]]
            if grams:
                return [sum(log(lang, n, g) for g in grams) / len(grams) for lang in langs]
        return [0.0] * len(langs)

    return langs, row


def test_model_and_backing_off_against_dictionaries(spark, edge):
    rows = [(i, lang, t) for i, (lang, t) in enumerate([("a", "the cat sat on the mat"), ("a", "a cat, a hat"), ("b", "der Hund und die Katze"), ("b", "\u00c4pfel 12 und \u2603"), ("c", "x"), (None, "not learned")])]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    model = langid.fit(docs, folds=1_000_003)
    langs, row = slow_model([(lang, t) for _, lang, t in rows if lang])
    assert model.langs == langs
    words = ["cat", "the", "cats", "hunde", "katz", "\u00e4pfel", "\u00e4", "zzz", "x", "q", "the"]
    assert np.allclose(model.rows(words), [row(w) for w in words], atol=1e-5)
    texts = ["the cats", "und hunde", "q", "", "12", "cat " * 500]
    for t, (lang, score) in zip(texts, model.predict(texts)):
        z = np.sum([row(w) for w in langid.words_of(t)] or [[0.0] * 3], axis=0)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        want = (langs[int(p.argmax())], p.max()) if langid.words_of(t) else ("und", 0.0)
        assert lang == want[0] and score == pytest.approx(want[1], abs=1e-4)


def test_numerals_are_no_letters(spark, edge):
    docs = spark.createDataFrame([(1, "\u00bd"), (2, "\u00b2 \u2167 12"), (3, "x\u00b2y")], "doc_id bigint, text string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.fit(edge)).collect()}
    assert got == {1: "und", 2: "und", 3: "en"} and langid.words_of("x\u00b2y") == ["x", "y"]


def test_an_id_with_several_texts_counts_once(spark):
    docs = spark.createDataFrame([(1, f"good words {i}") for i in range(50)] + [(k, f"other text {k}") for k in range(2, 12)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 12)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels, sample=20)
    taught = [k for k in range(1, 12) if zlib.crc32(str(k).encode()) % 5]
    assert sorted(model.labels.tolist()) == sorted(float(k % 2) for k in taught)


def test_rejected_documents_go(edge):
    kept = langid.keep_identified(edge, langid.fit(edge))
    assert kept.columns == edge.columns and kept.where("text is null or trim(text) = ''").isEmpty()


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id"), "doc_id", "left_semi"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out")
    hit = got.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("share")).collect()
    assert {r.quality: r.share > 0.9 for r in hit} == {0: True, 1: True}


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, 0), (5, 7, 0), (6, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality.classify(edge, labels).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    assert quality.classify(empty, labels).count() == 0
    assert {r.score for r in quality.classify(edge, labels.limit(0)).collect()} == {0.5}


def test_votes_are_exact_nearest_neighbours(spark, sf):
    import numpy as np

    docs = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    x = np.stack([quality.terms(t) for t in docs[:120]]).astype(np.float32)
    m = quality.decompose(x, np.arange(120) % 2 * 1.0, 16)
    z = m.embed(docs)
    got = m.score(docs, block=7)
    for v, s in zip(z, got):
        c = [float(v @ u) for u in m.vectors]
        top = sorted(range(len(c)), key=lambda i: -c[i])[: quality.NEIGHBOURS]
        w = [max(0, c[i]) ** quality.SHARPNESS for i in top]
        want = (sum(a * m.labels[i] for a, i in zip(w, top)) + 1e-6 * m.prior) / (sum(w) + 1e-6)
        assert abs(s - want) < 1e-4
