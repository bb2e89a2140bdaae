"""Readers of run directories and journals: what is missing, torn, escaped or broken."""

import hashlib
import io
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keelson.plans.registry import QUERIES
from keelson.sources import journal as J
from keelson.sources import run_dir as R
from keelson.sources.files import lines_of, manifest, put_files, put_named, write_files


def put(base, path, content):
    f = base / path
    f.parent.mkdir(parents=True, exist_ok=True)
    f.write_bytes(content if isinstance(content, bytes) else content.encode())


PROM = """# HELP depth Queue "depth".
# TYPE depth gauge
depth{stage="a,b=\\"c\\"",other="x\\\\y"} 1.5
depth{stage="d"} -2 1700000000
# TYPE ops counter
ops 7

# TYPE lat histogram
lat_bucket{m="put",le="0.5"} 1
lat_bucket{m="put",le="+Inf"} 3
lat_sum{m="put"} 0.75
lat_count{m="put"} 3
# TYPE gone summary
gone{quantile="0.5"} 4
gone_sum 9
gone_count 2
bare_count 11
inf_value +Inf
"""


def test_metric_text(spark, tmp_path):
    put(tmp_path, "storage-a.prom", PROM)
    put(tmp_path, "storage-b.prom", "ops 1\n")
    put(tmp_path, "coordinator.prom", "ops 5\n")
    paths = R.metric_files(spark, f"file://{tmp_path}", "storage-")
    assert [p.rpartition("/")[2] for p in paths] == ["storage-a.prom", "storage-b.prom"]
    with pytest.raises(FileNotFoundError):
        R.metric_files(spark, f"file://{tmp_path}", "nothing-")
    found = R.metrics(spark, paths[0])
    assert {r.labels["stage"]: r.value for r in R.gauges(found, "depth").collect()} == {'a,b="c"': 1.5, "d": -2.0}
    assert R.gauges(found, "depth").where("labels['other'] is not null").first().labels["other"] == "x\\y"
    assert [tuple(r)[1:] for r in R.histograms(found, "lat").collect()] == [({"m": "put"}, 3, 0.75)]
    assert R.histograms(found, "missing").count() == R.counters(found, "depth").count() == 0
    flat = {r.name: r.value for r in R.flat_metrics(found).collect()}
    assert flat == {'depth{other=x\\y,stage=a,b="c"}': 1.5, "depth{stage=d}": -2.0, "ops": 7.0, "lat": 0.75, "gone{}": 0.0, "gone{quantile=0.5}": 0.0, "bare_count": 11.0, "inf_value": float("inf")}


def test_traces_need_every_node_and_timeouts_do_not(spark, tmp_path):
    line = lambda at, n: json.dumps({"at": at, "node_id": n, "slot": 1, "sequence": 2, "chain_version": 1, "role": "head", "stage": "s"})
    run = f"file://{tmp_path}"
    for n, at in zip(R.NODES[:2], ("2026-01-01T00:00:02Z", "2026-01-01T00:00:01Z")):
        put(tmp_path, f"artifacts/{n}/write-pipeline-trace.jsonl", line(at, n) + "\n\n")
        put(tmp_path, f"artifacts/{n}/write-timeout-artifacts.jsonl", json.dumps({"at": at, "sequence": 4}) + "\n")
    put(tmp_path, "artifacts/other/write-timeout-artifacts.jsonl", '{"sequence": 5}\n')
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        R.traces(spark, run).collect()
    put(tmp_path, f"artifacts/{R.NODES[2]}/write-pipeline-trace.jsonl", line("2026-01-01T00:00:00Z", R.NODES[2]))
    assert [r.node_id for r in R.traces(spark, run).collect()] == R.NODES[::-1]
    assert [r.sequence for r in R.timeouts(spark, run, "at timestamp, sequence bigint").collect()] == [4, 4]
    put(tmp_path, f"artifacts/{R.NODES[0]}/write-timeout-artifacts.jsonl", "{broken\n")
    with pytest.raises(Exception, match="MALFORMED"):
        R.timeouts(spark, run, "at timestamp, sequence bigint").collect()


def test_lines_keep_their_order(spark, tmp_path):
    put(tmp_path, "p.jsonl", "".join(f'{{"version": {k}}}\n' for k in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = [r.version for r in R.json_lines(spark, f"file://{tmp_path}/p.jsonl", "version bigint").sort("place").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(range(20_000))


@pytest.mark.parametrize("binary", [True, False])
def test_journals_end_where_they_are_torn(spark, tmp_path, binary):
    encode = J.encode_binary if binary else J.encode_json
    records = [{"type": "prepare", "slot": 3, "chain_version": 1, "sequence": k, "kind": "put", "key": f"ké{k}", "value": "v" * k} for k in range(1, 6)]
    raw = b"".join(map(encode, records))
    parse = J.binary_records if binary else J.json_records
    assert [r["sequence"] for r in parse(raw)] == [1, 2, 3, 4, 5] and next(parse(raw))["key"] == "ké1"
    sizes = [len(encode(r)) for r in records]
    for cut in range(len(raw)):  # every way to lose a tail keeps all whole records
        whole = sum(sum(sizes[:k]) <= cut for k in range(1, 6))
        assert len(list(parse(raw[:cut]))) == whole
    put(tmp_path, "segment-00000002.log", raw[:-1])
    put(tmp_path, "segment-00000001.log", raw)
    put(tmp_path, "notes.txt", b"x")
    got = J.journal(spark, f"file://{tmp_path}", binary).sort("file", "at").collect()
    assert [r.sequence for r in got] == [1, 2, 3, 4, 5, 1, 2, 3, 4]
    if binary:
        assert [r["type"] for r in J.binary_records(J.encode_binary({**records[0], "type": "commit"}))] == [""]
    else:
        with pytest.raises(ValueError):
            list(J.json_records(b"\x02\x00\x00\x00{x"))


def test_manifest_lists_what_is_there(spark, tmp_path):
    files = spark.createDataFrame([("a/b.txt", bytearray(b"x")), ("c.txt", bytearray(b""))], "path string, content binary")
    base = f"file://{tmp_path}/run"
    made = write_files(files, base)
    assert [m[:2] for m in made] == [("a/b.txt", 1), ("c.txt", 0)]
    assert sorted(map(tuple, manifest(spark, base).collect())) == made


def test_a_long_file_is_parts_in_order(spark, tmp_path):
    """Of a run's lines three quarters are one node's: no row and no task holds its file, and its lines keep their order."""
    rows = spark.range(4_000).selectExpr("if(id % 4 = 0, 'storage-a', 'storage-b') as node", "(id * 7919) % 4000 as n")
    lines = lines_of(rows, F.concat("node", F.lit("/p.jsonl")), ["n"], F.to_json(F.struct(F.col("n").alias("version"))), parts=True)
    assert lines.agg(F.max(F.length("content"))).first()[0] < 30
    base = f"file://{tmp_path}/run"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        put_files(lines, base)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [len(p.read_text().splitlines()) for p in (tmp_path / "run/storage-b/p.jsonl").iterdir()]
    assert len(sizes) > 2 and max(sizes) < 2_000 and sum(sizes) == 3_000
    found = R.json_lines(spark, [f"{base}/{n}/p.jsonl" for n in R.NODES[:2]], "version bigint")
    assert {r[0].rpartition("/")[2] for r in found.select("file").distinct().collect()} == {"p.jsonl"}
    for node, n in (("a", 1_000), ("b", 3_000)):
        got = [r.version for r in found.where(F.col("file").contains(f"storage-{node}")).sort("place").collect()]
        assert got == sorted(set(got)) and len(got) == n


def test_timeouts_of_parts(spark, tmp_path):
    put(tmp_path, f"artifacts/{R.NODES[0]}/write-timeout-artifacts.jsonl/part-00000", '{"sequence": 1}\n')
    put(tmp_path, f"artifacts/{R.NODES[0]}/write-timeout-artifacts.jsonl/part-00001", '{"sequence": 2}\n')
    put(tmp_path, f"artifacts/{R.NODES[1]}/write-pipeline-trace.jsonl/part-00000", '{"sequence": 3}\n')
    assert sorted(r.sequence for r in R.timeouts(spark, f"file://{tmp_path}", "at timestamp, sequence bigint").collect()) == [1, 2]


def test_line_numbers_over_parts_and_splits(spark, tmp_path):
    """Numbers go on over parts and splits of a file, blank lines have none, and no window takes a file's lines."""
    at = 0
    for part, n in enumerate((700, 1, 1_300)):
        put(tmp_path, f"a/p.jsonl/part-{part:05d}", "".join(f'{{"version": {k}}}\n' + "\n" * (k % 3 == 0) for k in range(at, at + n)))
        at += n
    put(tmp_path, "b/p.jsonl", "".join(f'{{"version": {k}}}\n' for k in range(900)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        found = R.numbered(R.json_lines(spark, [f"file://{tmp_path}/{d}/p.jsonl" for d in "ab"], "version bigint"))
        assert found.select("place.part", "place.block").distinct().count() > 5
        got = sorted((r.file.split("/")[-2], r.line, r.version) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [("a", k + 1, k) for k in range(2_001)] + [("b", k + 1, k) for k in range(900)]
    assert "row_number" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_the_line_before_over_buckets(spark, monkeypatch):
    """No window takes more than a bucket and the line before it."""
    monkeypatch.setattr(R, "BUCKET", 4)
    lines = spark.createDataFrame([(f, k, 10 * k) for f, n in (("a", 13), ("b", 4), ("c", 1)) for k in range(1, n + 1)], "file string, line bigint, v bigint")
    got = R.with_previous(lines, "p", "v")
    assert sorted((r.file, r.line, r.v, r.p and r.p.v) for r in got.collect()) == [(f, k, 10 * k, 10 * (k - 1) if k > 1 else None) for f, n in (("a", 13), ("b", 4), ("c", 1)) for k in range(1, n + 1)]
    windows = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x]
    assert windows and all("bucket" in x for x in windows)


@pytest.mark.parametrize("binary", [True, False])
def test_segments_are_written_and_read_by_records(spark, tmp_path, monkeypatch, binary):
    """No row or batch holds a segment, when written or when read."""
    rows = spark.range(3_000).selectExpr("id % 3 as segment", "'prepare' as type", "id % 7 as slot", "1L as chain_version", "(id * 1009) % 3000 as sequence", "repeat('v', 50) as value")
    made = J.segments(rows, "segment", "sequence", binary)
    assert made.count() == 3_000 and made.agg(F.max(F.length("content"))).first()[0] < 250
    assert made.where("last").count() == 3
    put_files(made, f"file://{tmp_path}")
    got = J.journal(spark, f"file://{tmp_path}", binary)
    want = sorted((f"segment-{k % 3:08d}.log", k * 1009 % 3000) for k in range(3_000))
    assert [(r.file.rpartition("/")[2], r.sequence) for r in got.sort("file", "at").collect()] == want
    monkeypatch.setattr(J, "ROWS", 64)
    raw = (tmp_path / "segment-00000001.log").read_bytes()
    parts = list(J._parsed(iter([pa.RecordBatch.from_pydict({"path": ["s"], "content": [raw]})]), J.binary_records if binary else J.json_records))
    assert max(b.num_rows for b in parts) == 64 and [a for b in parts for a in b.column("at").to_pylist()] == list(range(1_000))


def test_a_file_of_one_task_is_written_by_lines(spark, tmp_path):
    """Rows are lines, and a file without parts is whole, in order, over several batches."""
    rows = spark.range(25_000).selectExpr("if(id < 24000, 0, id % 50) as run", "(id * 7) % 25000 as seq")
    made = lines_of(rows, F.concat(F.lit("run-"), "run", F.lit(".jsonl")), ["seq"], F.to_json(F.struct(F.col("seq").alias("version"))))
    assert made.count() == 25_000 and made.agg(F.max(F.length("content"))).first()[0] < 30
    put_files(made, f"file://{tmp_path}/run")
    assert len(list((tmp_path / "run").iterdir())) == 50
    found = [json.loads(x)["version"] for x in (tmp_path / "run/run-0.jsonl").read_text().splitlines()]
    assert found == sorted(found) and len(found) == 24_020
    assert R.progress(spark, f"file://{tmp_path}/run").count() == 25_000


@pytest.mark.parametrize("binary", [True, False])
def test_segments_are_read_by_name_and_by_records(spark, tmp_path, binary):
    """A reader asks for a head or a record at a time, and of segments torn or whole the records are those of the reader of folders."""
    encode, parse = (J.encode_binary, J.binary_records) if binary else (J.encode_json, J.json_records)
    raw = b"".join(encode({"type": "prepare", "slot": 3, "chain_version": 1, "sequence": k, "kind": "put", "key": "k", "value": "v" * 40}) for k in range(500))

    class Source(io.BytesIO):
        asked = []

        def read(self, n=-1):
            self.asked.append(n)
            return super().read(n)

    assert list(parse(Source(raw[:-1]))) == list(parse(raw))[:-1] and 0 < min(Source.asked) and max(Source.asked) < 250
    rows = spark.range(3_000).selectExpr("id % 30 as segment", "'prepare' as type", "id % 7 as slot", "1L as chain_version", "(id * 1009) % 3000 as sequence")
    made = J.segments(rows, "segment", "sequence", binary).withColumn("content", F.expr("if(last, substr(content, 1, length(content) - 3), content)"))
    files = put_named(made, base := f"file://{tmp_path}/run")
    assert files.count() == 30
    plain = lambda df: sorted((r.file.rpartition("/")[2], r.at, r.sequence) for r in df.collect())
    got = plain(J.journal_of(files, base, binary))
    assert len(got) == 2_970 and got == plain(J.journal(spark, base, binary))


def test_lines_of_files_by_name(spark, tmp_path):
    """Lines longer than a block, blank ones, a file without its last line end and an empty one; broken lines are errors."""
    texts = {"a.jsonl": '{"version": 1}\r\n\n{"version": 2, "x": "' + "y" * 3_000_000 + '"}\n{"version": 3}', "b.jsonl": "", "c.jsonl": "".join(f'{{"version": {k}}}\n' for k in range(25_000))}
    base = f"file://{tmp_path}/run"
    files = put_named(spark.createDataFrame([(p, bytearray(t.encode())) for p, t in texts.items()], "path string, content binary"), base)
    got = [tuple(r) for r in R.progress_of(files, base).select("file", "line", "version").sort("file", "line").collect()]
    assert got == [("a.jsonl", 1, 1), ("a.jsonl", 3, 2), ("a.jsonl", 4, 3)] + [("c.jsonl", k + 1, k) for k in range(25_000)]
    put(tmp_path, "run/b.jsonl", "{broken\n")
    with pytest.raises(Exception, match="MALFORMED"):
        R.progress_of(files, base).collect()


@pytest.mark.parametrize("name", ["SRC8_json_journal", "SRC9_binary_journal", "SRC10_journal_segments", "SRC20_progress_records"])
def test_files_of_runs_are_not_listed(spark, name):
    """The driver plans over the manifest, not over a file a segment or run."""
    assert not [f for f in QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles() if f.endswith((".log", ".jsonl"))]


def test_the_driver_holds_no_names_of_a_manifest(spark, tmp_path, monkeypatch):
    """Names go from the listing to the tasks that hash them; without signups there are no files, which is no error."""

    def refused(*_, **__):
        raise AssertionError("rows pass through the driver")

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.where("event_type <> 'signup'").write.parquet(f"{tmp_path}/none/events.parquet")
    with monkeypatch.context() as m:
        m.setattr(type(e), "collect", refused)
        m.setattr(type(spark), "createDataFrame", refused)
        got, none = (QUERIES["SNK10_artifact_manifest"](spark, sf) for sf in ("/root/testdata/sf0.001", str(tmp_path / "none")))
    rows = got.collect()
    assert len(rows) == e.where("event_type = 'signup'").count() and [r.path for r in rows] == sorted(r.path for r in rows)
    assert none.collect() == []


def test_manifest_of_folders_in_folders(spark, tmp_path):
    """More names than a batch, names that Spark's readers skip, empty folders; by path, however the listing gives them."""
    texts = {f"many/{k}": b"" for k in range(10_050)} | {"a": b"1", "b/c/d/e.txt": b"22", "b/_x": b"3", "b/c/.y": b"4", "b.txt": b"5", "\u00e9 %20/#?": b"6"}
    for path in {p.rpartition("/")[0] for p in texts} | {"empty/too"}:
        (tmp_path / "run" / path).mkdir(parents=True, exist_ok=True)
    for path, text in texts.items():
        (tmp_path / "run" / path).write_bytes(text)
    for base in (f"file://{tmp_path}/run", f"file://{tmp_path}/run/"):
        assert [tuple(r) for r in manifest(spark, base).collect()] == [(p, len(t), hashlib.sha256(t).hexdigest()) for p, t in sorted(texts.items())]


def test_manifest_of_the_folder_that_holds_its_listing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("keelson.sources.files.shared_dir", lambda _, name: f"file://{tmp_path}/{name}")
    (tmp_path / "a").write_bytes(b"1")
    assert [r.path for r in manifest(spark, f"file://{tmp_path}").collect()] == ["a"]
