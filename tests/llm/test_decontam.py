import hashlib
import re

import pytest

from keelson.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def slow(docs, items):
    windows = []
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(13, len(w))
        windows += [(str(i) if i is not None else "", tuple(w[a : a + n])) for a in range(len(w) - n + 1)] if n else []
    by_size = {}
    for i, w in windows:
        by_size.setdefault(len(w), {}).setdefault(w, set()).add(i)
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for n, known in by_size.items():
            for a in range(len(w) - n + 1):
                if ids := known.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def check(docs, bench):
    got = [tuple(r) for r in decontam.contamination(docs, bench).collect()]
    assert sorted(got, key=str) == slow([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])


def test_against_all_windows(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))


@pytest.fixture
def bench(spark, edge):
    base = edge.where("doc_id = 11").first().text.split()
    items = [(1, " ".join(base[5:40])), (2, "X"), (3, None), (4, ""), (None, " ".join(base[50:70])), (2, "für äpfel"), (10, " ".join(base[5:40])), (7, "nothing like any of it"), (8, "a " * 40)]
    return spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")


def test_edges(spark, edge, empty, bench, monkeypatch):
    check(edge, bench)
    check(empty, bench)
    check(edge, bench.limit(0))
    repeated = spark.createDataFrame([(1, "a " * 100 + "b"), (2, "a " * 12), (3, "b " + "a " * 13)], "doc_id bigint, text string")
    check(repeated, bench)
    monkeypatch.setattr(decontam, "ITEMS_PER_FILE", 2)
    check(edge, bench)


def test_longest_matches(spark, edge, bench):
    got = decontam.matches(edge.where("doc_id in (11, 15)"), bench).collect()
    assert {(r.doc_id, r.item_id, r.n_words) for r in got} == {(11, "1", 35), (11, "10", 35), (11, "", 20), (15, "1", 35), (15, "10", 35), (15, "", 20)}
    words = {r.doc_id: WORD.findall(lower(r.text)) for r in edge.where("doc_id in (11, 15)").collect()}
    texts = {str(r.item_id) if r.item_id is not None else "": WORD.findall(lower(r.text)) for r in bench.where("item_id in (1, 10) or item_id is null").collect()}
    for r in got:
        assert words[r.doc_id][r.doc_word : r.doc_word + r.n_words] == texts[r.item_id][r.item_word : r.item_word + r.n_words]


def test_clean_keeps_the_others(edge, bench):
    kept = decontam.clean(edge, bench)
    assert kept.columns == edge.columns
    bad = [r.doc_id for r in decontam.contamination(edge, bench).where("contaminated").collect()]
    assert kept.count() == edge.count() - len(bad)
