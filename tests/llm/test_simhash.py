import xxhash

from keelson.llm import simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    """Smallest id reachable by links of at most four bits, all pairs compared."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return {f: least.get(find(f)) for f in fps}


def check(docs, block=simhash.BLOCK):
    got = simhash.near_duplicates(docs, block=block).collect()
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    want = slow_components(rows)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=str) == sorted(((d, f, want[f]) for d, f in rows), key=str)


def test_against_all_pairs(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_edges(edge, empty):
    check(edge)
    assert simhash.near_duplicates(empty).count() == 0


def test_large_postings_are_dealt_in_blocks(spark):
    # 400 fingerprints around one centre: their postings exceed the block and are split
    import random

    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = {centre} | {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)} | {rng.getrandbits(64) for _ in range(200)}
    from keelson.llm.components import components

    want = slow_components([(f, f) for f in fps])
    for block in (16, 4096):
        links = simhash.fingerprint_links(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp bigint"), block)
        got = {r.node % (1 << 64): r.root % (1 << 64) for r in components(links, "a", "b").collect()}
        same = {}
        for f in fps:
            same.setdefault(want[f], set()).add(got.get(f, f))
        assert all(len(s) == 1 for s in same.values())
        assert len({next(iter(s)) for s in same.values()}) == len(same)


def test_one_of_each_group_stays(edge, empty):
    kept = simhash.one_of_each(edge)
    assert kept.columns == edge.columns
    near = simhash.near_duplicates(edge)
    assert kept.count() == near.select("fp").join(near.groupBy("fp").agg({"component_id": "min"}), "fp").select("min(component_id)").distinct().count()
    assert simhash.one_of_each(empty).count() == 0


def test_components_of_a_long_chain(spark):
    from keelson.llm.components import components

    n = 300
    chain = spark.createDataFrame([((i * 7919) % n, ((i + 1) * 7919) % n) for i in range(n - 1)] + [(5, 5), (None, 3)], "a bigint, b bigint")
    got = components(chain, "a", "b").collect()
    assert len(got) == n - 1 and {r.root for r in got} == {0}
    assert components(chain.limit(0), "a", "b").count() == 0
