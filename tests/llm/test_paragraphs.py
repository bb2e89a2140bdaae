import random
from collections import defaultdict

from keelson.llm import paragraphs as P


def lines_of(docs):
    for i, r in enumerate(docs.select("doc_id", "text").collect()):
        for k, line in enumerate((r.text or "").split("\n")):
            w = line.encode("utf-8", "surrogatepass").lower().split()
            if len(w) >= P.LEAST:
                yield i, r.doc_id, k, w


def slow_pairs(docs):
    """Whole paragraphs of two rows whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    rows = list(lines_of(docs))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for *_, w in rows]
    by = defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            by[g].add(i)
    out = set()
    for i, s in enumerate(sets):
        near = defaultdict(int)
        for g in s:
            for j in by[g]:
                if j < i:
                    near[j] += 1
        for j, both in near.items():
            if both >= 0.8 * (len(s) + len(sets[j]) - both):
                out.add((j, i))
    return rows, out


def check(docs, block=P.BLOCK):
    rows, pairs = slow_pairs(docs)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    groups = defaultdict(list)
    for i, (row, doc, k, w) in enumerate(rows):
        groups[find(i)].append((row, doc, k, len(w)))
    want = sorted(str((d, k, n)) for g in groups.values() if len({x[0] for x in g}) > 1 for _, d, k, n in g)
    got = P.repeats(docs, block=block).where("whole").collect()
    assert sorted(str((r.doc_id, r.line, r.n_words)) for r in got) == want
    kept = defaultdict(int)
    for r in got:
        kept[r.class_key] += not r.removed
    assert all(n == 1 for n in kept.values())
    assert len(kept) == sum(len({x[0] for x in g}) > 1 for g in groups.values())


def test_small_table(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_edges(edge, empty):
    check(edge)
    assert P.repeats(empty).count() == 0


def test_many_variants_in_blocks(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(120)] = f"v{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"x{rng.randrange(4000)}" for _ in range(60))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    check(docs, block=8)
    check(docs)


def test_passages_inside_paragraphs(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passage = text(70)
    docs = spark.createDataFrame([(i, f"{text(40)} {passage} {text(50)}\n{text(30)}") for i in range(4)] + [(9, text(200))], "doc_id bigint, text string")
    got = P.repeats(docs).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3} and {r.doc_id for r in got if r.removed} == {1, 2, 3}
    left = {r.doc_id: len(r.text.split()) for r in P.without_repeats(docs).collect()}
    assert left[0] == 190 and left[9] == 200 and all(120 <= left[i] < 175 for i in (1, 2, 3))


def test_without_repeats_keeps_rows_and_columns(edge):
    out = P.without_repeats(edge)
    assert out.columns == edge.columns and out.count() == edge.count()


def slow_runs(docs):
    """Words (row, line, word) of every LEAST words in a row of whole texts that two rows have."""
    texts = []
    for i, r in enumerate(docs.select("doc_id", "text").collect()):
        flat = [(k, j, w) for k, line in enumerate((r.text or "").split("\n")) for j, w in enumerate(line.encode("utf-8", "surrogatepass").lower().split())]
        texts.append((r.doc_id, flat))
    rows_of = defaultdict(set)
    for i, (_, flat) in enumerate(texts):
        for a in range(len(flat) - P.LEAST + 1):
            rows_of[tuple(w for *_, w in flat[a : a + P.LEAST])].add(i)
    out = []
    for _, (doc, flat) in enumerate(texts):
        words = set()
        for a in range(len(flat) - P.LEAST + 1):
            if len(rows_of[tuple(w for *_, w in flat[a : a + P.LEAST])]) > 1:
                words.update(x[:2] for x in flat[a : a + P.LEAST])
        out += [(str(doc), *x) for x in words]
    return sorted(out)


def check_runs(docs):
    got = P.repeats(docs).where("not whole").collect()
    assert sorted((str(r.doc_id), r.line, j) for r in got for j in range(r.first_word, r.end_word)) == slow_runs(docs)
    kept = defaultdict(set)
    for r in got:
        kept[r.class_key].add(r.removed)
        assert r.removed or r.class_doc_id == r.doc_id
    return got


def test_all_verbatim_runs_of_whole_texts(spark, sf, edge):
    check_runs(spark.read.parquet(f"{sf}/documents.parquet"))
    check_runs(edge)


def test_passages_in_short_lines_and_of_any_length(spark):
    rng = random.Random(12)
    text = lambda n: [f"w{rng.randrange(5_000_000)}" for _ in range(n)]
    lay = lambda w, n: "\n".join(" ".join(w[a : a + n]) for a in range(0, len(w), n))
    rows, n = [], 0
    for length in [19, 20, 21, 34, 51, 51, 51, 52, 60, 75]:
        passage = text(length)
        for width in (17, 23, 1000):
            rows.append((n, lay(text(rng.randrange(40)) + passage + text(rng.randrange(40)), width)))
            n += 1
    common = text(51)
    rows += [(n + i, lay(text(30) + common + text(30), 11 + i % 9)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    got = check_runs(docs)
    assert {r.doc_id for r in got} == set(range(3, n + 20))
    assert {r.doc_id for r in got if not r.removed} == {*range(3, n, 3), n}
    left = {r.doc_id: len(r.text.split()) for r in P.without_repeats(docs).collect()}
    assert sorted(left[n + i] for i in range(20)) == [60] * 19 + [111]  # the first row keeps it, and rows are in no order of ids
