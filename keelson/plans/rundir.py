"""Queries that write a run directory from the tables and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.plans.log import JOURNAL, LOG, _journal
from keelson.plans.names import query
from keelson.plans.telemetry import COUNTERS, PROGRESS, TRACE, _progress, _trace
from keelson.sources import journal as J
from keelson.sources import run_dir as R
from keelson.sources import tables as S
from keelson.sources.files import lines_of, manifest, put_files, put_named, shared_dir, write_files

# a target's file: a gauge of each stage, one counter of all, an untyped number and a histogram of each stage and role
FAMILIES = f"""{COUNTERS}, fam AS (
    SELECT target, 'queue_depth' AS family, 'gauge' AS kind, 'stage=' || stage AS labels, CAST(count(*) % 50 AS DOUBLE) AS value, NULL AS n FROM counters GROUP BY target, stage
    UNION ALL SELECT target, 'ops_total', 'counter', '', CAST(count(*) AS DOUBLE), NULL FROM counters GROUP BY target
    UNION ALL SELECT target, 'odd', 'untyped', '', CAST(max(seq) AS DOUBLE), NULL FROM counters GROUP BY target
    UNION ALL SELECT target, 'stage_seconds', 'histogram', 'role=' || role || ',stage=' || stage, CAST(sum(seq) AS DOUBLE), count(*) FROM counters GROUP BY target, stage, role)"""
def _target():
    return F.regexp_extract("file", r"([^/]+)\.prom$", 1).alias("target")


def _snapshot(spark, sf) -> str:
    """Writes a metric snapshot of the counters and gives its folder."""
    c = S.counters(spark, sf)
    label = lambda k: F.concat(F.lit(f'{k}="'), k, F.lit('"'))
    row = lambda df, line, order: df.select("target", F.lit(order).alias("o"), line.alias("line"))
    by_stage = c.groupBy("target", "stage").agg(F.count("*").alias("n"))
    by_role = c.groupBy("target", "stage", "role").agg(F.count("*").alias("n"), F.sum("seq").alias("s"))
    total = c.groupBy("target").agg(F.count("*").alias("n"), F.max("seq").alias("m"))
    both = F.concat(label("stage"), F.lit(","), label("role"))
    rows = [
        row(total, F.lit("# TYPE queue_depth gauge\n# TYPE ops_total counter\n# TYPE stage_seconds histogram\n# HELP odd nothing"), 0),
        row(by_stage, F.concat(F.lit("queue_depth{"), label("stage"), F.lit("} "), F.col("n") % 50), 1),
        row(total, F.concat(F.lit("ops_total "), "n", F.lit("\nodd "), "m"), 2),
        row(by_role, F.concat(F.lit("stage_seconds_bucket{"), both, F.lit(',le="+Inf"} '), "n", F.lit("\nstage_seconds_sum{"), both, F.lit("} "), "s", F.lit("\nstage_seconds_count{"), both, F.lit("} "), "n"), 3),
    ]
    all_rows = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    base = shared_dir(spark, "snapshot")
    put_files(lines_of(all_rows, F.concat("target", F.lit(".prom")), ["o", "line"], F.col("line")), base)
    return base


def _metrics(spark, sf) -> DataFrame:
    return R.metrics(spark, R.metric_files(spark, _snapshot(spark, sf), "store-"))


@query("SRC11_flat_metrics", f"WITH {FAMILIES}, c AS (SELECT *, count(*) OVER (PARTITION BY target, family) AS many FROM fam) SELECT target, CASE WHEN many = 1 THEN family ELSE family || '{{' || labels || '}}' END AS name, value FROM c")
def flat_metrics(spark, sf):
    return R.flat_metrics(_metrics(spark, sf)).select(_target(), "name", "value")


@query("SRC12_metric_values", f"WITH {FAMILIES} SELECT target, family, count(*) AS metrics, sum(value) AS total FROM fam GROUP BY target, family")
def metric_values(spark, sf):
    return R.chosen_values(_metrics(spark, sf)).groupBy(_target(), "family").agg(F.count("*").alias("metrics"), F.sum("value").alias("total"))


@query("SRC13_histogram_family", f"WITH {FAMILIES} SELECT target, labels, n AS count, value AS sum FROM fam WHERE family = 'stage_seconds'")
def histogram_family(spark, sf):
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return R.histograms(_metrics(spark, sf), "stage_seconds").select(_target(), listed.alias("labels"), "count", "sum")


@query("SRC14_gauge_family", f"WITH {FAMILIES} SELECT target, labels[7:] AS stage, value FROM fam WHERE family = 'queue_depth'")
def gauge_family(spark, sf):
    return R.gauges(_metrics(spark, sf), "queue_depth").select(_target(), F.col("labels")["stage"].alias("stage"), "value")


@query("SRC15_counter_family", f"WITH {FAMILIES} SELECT target, value FROM fam WHERE family = 'ops_total'")
def counter_family(spark, sf):
    return R.counters(_metrics(spark, sf), "ops_total").select(_target(), "value")


@query("SRC16_snapshot_files", f"WITH {COUNTERS} SELECT DISTINCT target || '.prom' AS name FROM counters")
def snapshot_files(spark, sf):
    paths = R.metric_files(spark, _snapshot(spark, sf), "store-")
    return spark.createDataFrame([(p.rpartition("/")[2],) for p in paths], "name string")


_NODE = "CASE slot % 3 WHEN 0 THEN 'storage-a' WHEN 1 THEN 'storage-b' ELSE 'storage-c' END"


def _json(df: DataFrame, node: str, file: str, order: list[str], *cols) -> DataFrame:
    line = F.to_json(F.struct(*cols), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    return lines_of(df, F.concat(F.lit("artifacts/"), F.expr(node), F.lit(f"/{file}")), order, line, parts=True)


@query("SRC17_write_traces", f"""WITH {TRACE} SELECT CAST(slot AS INTEGER) AS slot, sequence, stage, "at", {_NODE} AS node_id FROM trace""")
def write_traces(spark, sf):
    base, t = shared_dir(spark, "run"), _trace(spark, sf)
    put_files(_json(t, _NODE, "write-pipeline-trace.jsonl", ["at", "sequence", "stage"], "at", F.expr(_NODE).alias("node_id"), "slot", "sequence", "stage"), base)
    return R.traces(spark, base).select("slot", "sequence", "stage", F.col("at").cast("timestamp_ntz").alias("at"), "node_id")


@query("SRC18_timeout_artifacts", """SELECT event_id AS sequence, ts AS "at", 'late ' || event_id AS error FROM events WHERE event_type = 'error' AND user_id % 3 <> 2""")
def timeout_artifacts(spark, sf):
    """The third node has no file, which is no error."""
    base = shared_dir(spark, "run")
    e = S.table(spark, sf, "events").where("event_type = 'error' and user_id % 3 <> 2").withColumn("slot", F.col("user_id") % 3)
    put_files(_json(e, _NODE, "write-timeout-artifacts.jsonl", ["event_id"], F.col("ts").alias("at"), F.col("event_id").alias("sequence"), F.concat(F.lit("late "), "event_id").alias("error")), base)
    return R.timeouts(spark, base, "at timestamp, sequence bigint, error string").select("sequence", F.col("at").cast("timestamp_ntz").alias("at"), "error")


def _probes(spark, sf) -> DataFrame:
    base, e = shared_dir(spark, "run"), S.table(spark, sf, "events").withColumn("slot", F.col("user_id") % 3)
    k = F.col("event_id")
    cpu = F.struct(*[(k * n).alias(c) for n, c in ((10, "user"), (1, "nice"), (20, "system"), (60, "idle"), (4, "iowait"), (2, "irq"), (2, "softirq"), (1, "steal"))])
    disk = F.create_map(F.lit("nvme0"), F.struct((k * 3).alias("reads_completed"), (k * 5).alias("writes_completed"), (k * 4096).alias("read_sectors"), (k * 8192).alias("write_sectors")))
    net = F.create_map(F.lit("eth0"), F.struct((k * 900_000).alias("rx_bytes"), (k * 300_000).alias("tx_bytes")))
    put_files(_json(e, _NODE, "probe.jsonl", ["event_id"], F.col("ts").alias("timestamp"), cpu.alias("cpu"), net.alias("network"), disk.alias("disks")), base)
    return R.probes(spark, [f"{base}/artifacts/{n}/probe.jsonl" for n in R.NODES])


@query("SRC19_probe_order", """SELECT CASE user_id % 3 WHEN 0 THEN 'storage-a' WHEN 1 THEN 'storage-b' ELSE 'storage-c' END AS node, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS line, event_id * 60 AS idle, event_id * 100 AS total FROM events""")
def probe_order(spark, sf):
    p = R.numbered(_probes(spark, sf))
    total = sum((F.col("cpu")[c] for c in ("nice", "system", "idle", "iowait", "irq", "softirq", "steal")), F.col("cpu")["user"])
    node = F.element_at(F.split("file", "/"), -2)
    return p.select(node.alias("node"), "line", F.col("cpu.idle").alias("idle"), total.alias("total"))


@query(
    "WIN6_disk_rates",
    """WITH p AS (SELECT user_id % 3 AS node, event_id AS k, ts, lag(event_id) OVER w AS pk, lag(ts) OVER w AS pts FROM events WINDOW w AS (PARTITION BY user_id % 3 ORDER BY event_id)), d AS (SELECT *, (epoch_us(ts) - epoch_us(pts)) / 1e6 AS s FROM p WHERE pk IS NOT NULL)
    SELECT 'storage-' || ['a', 'b', 'c'][CAST(node AS INTEGER) + 1] AS node, ts AS "at", round((k - pk) * 4096 * 512 / s / 1024 / 1024, 4) AS read_mb_s, round((k - pk) * 8192 * 512 / s / 1024 / 1024, 4) AS write_mb_s FROM d WHERE s > 0""",
)
def disk_rates(spark, sf):
    """Sectors of 512 bytes between a probe and the one before, of all disks that are there now."""
    p = R.with_previous(R.numbered(_probes(spark, sf)), "p", "timestamp", "disks").where("p is not null")
    s = (F.unix_micros("timestamp") - F.unix_micros("p.timestamp")) / 1e6
    moved = lambda c: F.aggregate(F.map_entries("disks"), F.lit(0).cast("bigint"), lambda a, e: a + e["value"][c] - F.coalesce(F.try_element_at("p.disks", e["key"])[c], F.lit(0)))
    rate = lambda c: F.round(moved(c) * 512 / s / 1024 / 1024, 4)
    return p.where(s > 0).select(F.element_at(F.split("file", "/"), -2).alias("node"), F.col("timestamp").cast("timestamp_ntz").alias("at"), rate("read_sectors").alias("read_mb_s"), rate("write_sectors").alias("write_mb_s"))


@query("SRC20_progress_records", f"WITH {PROGRESS} SELECT run, seq AS version, slots AS slot_count, writable AS writable_slots, readable AS readable_slots, pending AS pending_slots, outbox AS outbox_entries FROM progress")
def progress_records(spark, sf):
    base, p = shared_dir(spark, "run"), _progress(spark, sf)
    line = F.to_json(F.struct(F.col("at").alias("time"), F.col("seq").alias("version"), F.col("slots").alias("slot_count"), F.col("writable").alias("writable_slots"), F.col("readable").alias("readable_slots"), F.col("pending").alias("pending_slots"), F.col("outbox").alias("outbox_entries")))
    files = put_named(lines_of(p, F.concat(F.lit("run-"), "run", F.lit(".jsonl")), ["seq"], line), base)
    run = F.regexp_extract("file", r"run-(\d+)\.jsonl$", 1).cast("bigint")
    return R.progress_of(files, base).select(run.alias("run"), "version", *[F.col(c).cast("bigint").alias(c) for c in ("slot_count", "writable_slots", "readable_slots", "pending_slots", "outbox_entries")])


_REPORTS = "SELECT strftime(ts, '%Y-%m-%d') AS name, count(*) AS total_ops, max(value) AS max_ms FROM events GROUP BY 1"


def _documents(spark, sf) -> str:
    base = shared_dir(spark, "reports")
    s = S.samples(spark, sf).groupBy(F.col("scenario").alias("name")).agg(F.count("*").alias("total_ops"), F.max("latency_ms").alias("max_ms"))
    doc = F.concat(F.to_json(F.struct("name", "total_ops", "max_ms"), {"pretty": "true"}), F.lit("\n")).cast("binary")
    write_files(s.select(F.concat("name", F.lit(".json")).alias("path"), doc.alias("content")), base)
    return base


@query("SRC21_json_documents", _REPORTS)
def json_documents(spark, sf):
    return R.document(spark, _documents(spark, sf), "name string, total_ops bigint, max_ms double")


@query("SNK7_json_sink", f"WITH r AS ({_REPORTS}) SELECT name || '.json' AS name, 5 AS lines FROM r")
def json_sink(spark, sf):
    """Documents are indented and end with a new line: a brace, three fields, a brace."""
    text = spark.read.text(_documents(spark, sf)).select(F.col("_metadata.file_name").alias("name"))
    return text.groupBy("name").agg(F.count("*").alias("lines"))


@query("SNK8_json_lines_sink", "SELECT user_id % 3 AS node, count(*) AS lines, min(event_id) AS first FROM events GROUP BY 1")
def json_lines_sink(spark, sf):
    base, e = shared_dir(spark, "run"), S.table(spark, sf, "events").withColumn("slot", F.col("user_id") % 3)
    put_files(_json(e, "slot", "samples.jsonl", ["event_id"], "event_id", "value"), base)
    found = R.json_lines(spark, [f"{base}/artifacts/{k}/samples.jsonl" for k in range(3)], "event_id bigint, value double")
    return found.groupBy(F.element_at(F.split("file", "/"), -2).cast("bigint").alias("node")).agg(F.count("*").alias("lines"), F.min("event_id").alias("first"))


@query("SNK10_artifact_manifest", "SELECT 'f/' || event_id || '.txt' AS path, strlen(props) AS size, sha256(props) AS sha256 FROM events WHERE event_type = 'signup'")
def artifact_manifest(spark, sf):
    """A listing of the files as they lie there, below whichever folders; signups are files."""
    base = shared_dir(spark, "artifacts")
    e = S.table(spark, sf, "events").where("event_type = 'signup'")
    put_files(e.select(F.concat(F.lit("f/"), "event_id", F.lit(".txt")).alias("path"), F.col("props").cast("binary").alias("content")), base)
    return manifest(spark, base)


# --- journals: segments by a thousand sequences of all slots; the last record of each is cut off where it is torn

def _records(spark, sf) -> DataFrame:
    return _journal(spark, sf).withColumn("segment", F.floor(F.col("sequence") / 20)).withColumn("order", F.struct("sequence", "slot", "type", "chain_version"))


def _journals(spark, sf, binary: bool, torn: bool) -> DataFrame:
    base = shared_dir(spark, "journal")
    made = J.segments(_records(spark, sf), "segment", "order", binary)
    files = put_named(made.withColumn("content", F.expr("if(last, substr(content, 1, length(content) - 3), content)")) if torn else made, base)
    return J.journal_of(files, base, binary)


_SEGMENTS = f"{LOG}, {JOURNAL}, seg AS (SELECT *, sequence // 20 AS segment, row_number() OVER (PARTITION BY sequence // 20 ORDER BY sequence DESC, slot DESC, type DESC, chain_version DESC) AS back FROM journal)"


@query("SRC9_binary_journal", f"{_SEGMENTS} SELECT type, slot, CAST(chain_version AS BIGINT) AS chain_version, sequence FROM seg WHERE back > 1")
def binary_journal(spark, sf):
    """A torn tail ends a file without an error."""
    return _journals(spark, sf, True, True).select("type", "slot", "chain_version", "sequence")


@query("SRC8_json_journal", f"{_SEGMENTS} SELECT type, slot, CAST(chain_version AS BIGINT) AS chain_version, sequence FROM seg WHERE back > 1")
def json_journal(spark, sf):
    return _journals(spark, sf, False, True).select("type", "slot", "chain_version", "sequence")


@query("SRC10_journal_segments", f"{_SEGMENTS} SELECT printf('segment-%08d.log', CAST(segment AS INTEGER)) AS name, count(*) AS records, min(sequence) AS first, max(sequence) AS last FROM seg GROUP BY segment")
def journal_segments(spark, sf):
    j = _journals(spark, sf, True, False)
    return j.groupBy(F.element_at(F.split("file", "/"), -1).alias("name")).agg(F.count("*").alias("records"), F.min("sequence").alias("first"), F.max("sequence").alias("last"))
