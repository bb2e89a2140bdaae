import corpus_pipeline
from keelson.llm import pii, simhash
from keelson.llm.common import table


def put(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return f"file://{folder}"


def one_of_each(rows):
    """Ids of the smallest documents of groups linked within four bits, all pairs compared."""
    fp = [simhash.fingerprint(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append((r.doc_id is None, r.doc_id or 0))
    return sorted(min(g) for g in groups.values())


def check(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = stage(spark, docs, sf)
        after = docs.collect()
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns and len(after) <= len(before), name
        ids = sorted(str(r.doc_id) for r in after)
        if name == "language_id":
            assert all(r.text and any(c.isalpha() for c in r.text) for r in after)
        elif name == "near_dedup":
            assert ids == sorted(str(None if null else i) for null, i in one_of_each(before))
        elif name == "pii":
            assert ids == sorted(str(r.doc_id) for r in before) and not any(pii.base_spans(r.text) for r in after)
        elif name == "mixing":
            assert ids == sorted(str(r.doc_id) for r in before) and all(0 <= r.taken <= 2 * r.size for r in after)
    return sorted(map(str, after))


def test_every_stage_and_the_whole(spark, sf, edge, empty, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "mixing"]
    some = put(spark, tmp_path / "edge", edge)
    want = check(spark, some)
    assert sorted(map(str, corpus_pipeline.run(spark, some).collect())) == want
    assert corpus_pipeline.run(spark, put(spark, tmp_path / "empty", empty)).count() == 0
    assert check(spark, sf)
