import hashlib
import random
import re
import time
from collections import defaultdict

import pytest

from keelson.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def slow(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in digits(m[0])]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


ODD = ["a@b.com_x@c.org", "@@a@b.c@d.e", "x@y", "x@y.", "a@b..c", "1.2.3.4.5.6.7.8", "0001.2.3.4", "999.1.1.1", "1.2.3", "4111 1111-1111 1111", "4111 1111 1111 1112", "+1 (411) 555-1507", "+1)))", "+12345678+12345678", "+1 23", "é@b.com ü.x@y.de!!", "1" * 50, "1.1.1.1@a.b", "", "a.b@c-d.e-f.g", "4-1-1", "+0 0000000 0.0.0.0"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert pii.base_spans(text) == slow(text)


def check(docs):
    want = {}
    rows = docs.select("doc_id", "text").collect()
    listed = lambda s: ",".join(f"{pii.KINDS[k]}:{a}:{z}" for k, a, z in s)
    for r in rows:
        base = slow(r.text or "") if len(r.text or "") < 50_000 or " " in (r.text or "") else []  # the plain forms take too long there
        want.setdefault(r.doc_id, []).append((*[sum(s[0] == k for s in base) for k in range(4)], hashlib.sha256(listed(base).encode()).hexdigest(), listed(base)))
    got = pii.personal_data(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        same = [w for w in want[r.doc_id] if w[:5] == (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)]
        assert same
        assert set(filter(None, same[0][5].split(","))) <= set(r.spans.split(","))
        assert len([s for s in r.spans.split(",") if s]) == sum(r[k] for k in ("n_email", "n_ip", "n_card", "n_phone")) + r.n_added


def test_small_table(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_edges(edge, empty):
    check(edge)
    assert pii.personal_data(empty).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"Some words here. Contact: +1 (411) 555-{1000 + i} thanks and more") for i in range(40)]
    rows += [(100, "Other words. Contact: (411) 555-7777 thanks"), (101, "In chapter 555 1234 567 there is nothing"), (102, "years 1234567 to 2345678 went by")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[100].n_added == 1 and got[100].spans == "phone:22:36"
    assert got[101].n_added == got[102].n_added == 0


def test_redaction(spark, edge):
    text = "mail a@b.com or +1 (411) 555-1507, card 4111 1111 1111 1111 at 10.0.0.1!"
    docs = edge.limit(1).drop("text").crossJoin(spark.createDataFrame([(text,)], "text string")).select(*edge.columns)
    r = pii.redact(docs).first()
    assert r.text == "mail [EMAIL] or [PHONE], card [CARD] at [IP]!" and r.n_chars == len(r.text)
    same = pii.redact(edge)
    assert same.columns == edge.columns and same.count() == edge.count()
    assert pii.redact_text("abcdef", [(0, 1, 3), (1, 2, 5)]) == "a[EMAIL]f"


def test_patterns_propose_words_of_any_shape(spark):
    rows = [(i, f"Some words here. Contact: +1 (411) 555-{1000 + i} thanks and more") for i in range(60)]
    rows += [(100, "Other words. Contact: ext#77b-9 thanks"), (101, "In chapter v2.1 there is nothing"), (102, "Contact: 4five6 again")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[100].spans == "phone:22:31" and got[100].n_phone == 0 and got[101].n_added == 0
    assert got[102].spans == "phone:9:15"


def slow_graph(edges, rounds=pii.ROUNDS, support=pii.SUPPORT, confidence=pii.CONFIDENCE):
    """The pattern-instance graph from dictionaries."""
    distinct = {}
    for kind, seed, instance, pattern in edges:
        distinct[kind, pattern, instance] = distinct.get((kind, pattern, instance), False) or seed
    seeds = {(k, i) for (k, _, i), seed in distinct.items() if seed}
    conf = {(k, i): float((k, i) in seeds) for k, _, i in distinct}
    for _ in range(rounds):
        by = defaultdict(list)
        for k, p, i in distinct:
            by[k, p].append(conf[k, i])
        share = {kp: sum(c) / len(c) for kp, c in by.items() if sum(c) >= support}
        miss = {}
        for (k, p, i), seed in distinct.items():
            if not seed and (k, p) in share:
                miss[k, i] = miss.get((k, i), 1.0) * max(1 - share[k, p], 1e-6)
        conf = {x: 1.0 if x in seeds else 1 - miss[x] if x in miss else 0.0 for x in conf}
    return {x for x, c in conf.items() if x not in seeds and c >= confidence}


def test_graph_against_dictionaries(spark):
    rng = random.Random(8)
    for _ in range(3):
        edges = [(rng.randrange(2), rng.random() < 0.6, f"i{rng.randrange(60)}", f"p{int(rng.random() ** 2 * 25)}") for _ in range(500)]
        seeds = {(k, i) for k, s, i, _ in edges if s}
        edges = [(k, (k, i) in seeds and int(i[1:]) % 5 > 0, i, p) for k, _, i, p in edges]
        got = pii.trusted_instances(spark.createDataFrame(edges, "kind int, seed boolean, instance string, pattern string"), support=4.0).collect()
        want = slow_graph(edges, support=4.0)
        assert want and {(r.kind, r.instance) for r in got} == want


def test_free_spans_against_all_pairs():
    rng = random.Random(1)
    for _ in range(200):
        taken = [(a, a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(8)))]
        fast = pii._Taken(taken)
        for a in range(70):
            z = a + rng.randrange(1, 6)
            assert fast.free(a, z) == (not any(x < z and a < y for x, y in taken))


def test_a_long_text_takes_time_in_proportion():
    text = "write to a.b@example.org or (411) 555-1507 now, ref 12ab " * 55_000
    began = time.process_time()
    found = pii.find(text)
    assert len(found["base"]) == 55_000 and len(found["slots"]) == 165_000 and time.process_time() - began < 60
