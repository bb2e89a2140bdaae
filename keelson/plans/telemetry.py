"""Queries of run telemetry: samples, counters, traces, timeouts, probes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators import folds
from keelson.operators import telemetry as M
from keelson.operators.log import last_n
from keelson.plans.names import query
from keelson.sources import tables as S

SAMPLES = """samples AS (SELECT event_id AS seq, ts AS "at", strftime(ts, '%Y-%m-%d') AS scenario, CASE WHEN event_type IN ('view', 'click') THEN 'get' ELSE 'put' END AS operation, value AS latency_ms, event_type <> 'error' AS successful FROM events)"""
COUNTERS = """counters AS (SELECT event_id AS seq, strftime(ts, '%Y-%m-%d') AS scenario, 'store-' || (user_id % 3) AS target, event_type AS stage, CASE WHEN user_id % 2 = 0 THEN 'head' ELSE 'tail' END AS role, CASE WHEN value > 100 THEN 'slow' ELSE 'success' END AS result, value / 1000 AS value FROM events)"""
SUMMARY = "count(*) AS total_ops, count(*) FILTER (successful) AS success_ops, count(*) FILTER (NOT successful) AS error_ops, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms, round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms, max(latency_ms) AS max_ms"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, since engines add in different orders."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("AGG3_operation_summary", f"WITH {SAMPLES} SELECT operation, {SUMMARY} FROM samples GROUP BY operation")
def operation_summary(spark, sf):
    return rounded(M.latency_summary(S.samples(spark, sf), ["operation"]))


@query("AGG4_scenario_summary", f"WITH {SAMPLES} SELECT scenario, {SUMMARY}, count(*) FILTER (operation = 'get') AS read_ops, count(*) FILTER (operation <> 'get') AS write_ops, 86400.0::DOUBLE AS seconds, round(count(*) / 86400.0, 6) AS throughput FROM samples GROUP BY scenario")
def scenario_summary(spark, sf):
    s = S.samples(spark, sf)
    return rounded(M.scenario_summary(s, s.select("scenario").distinct().withColumn("seconds", F.lit(86400.0))))


@query(
    "AGG6_histogram",
    f"""WITH {SAMPLES}, uppers AS (SELECT unnest({M.BOUNDS}::DOUBLE[]) AS upper, unnest([0.0] || {M.BOUNDS[:-1]}::DOUBLE[]) AS lower),
    groups AS (SELECT operation, max(latency_ms * 5) AS most FROM samples GROUP BY operation),
    bins AS (SELECT operation, lower, upper FROM groups, uppers UNION ALL SELECT operation, 1000.0, ceil(most) FROM groups WHERE most > 1000)
    SELECT b.operation, b.upper, count(s.seq) AS n FROM bins b LEFT JOIN samples s ON s.operation = b.operation AND s.latency_ms * 5 <= b.upper AND (s.latency_ms * 5 > b.lower OR b.lower = 0) GROUP BY b.operation, b.upper""",
)
def histogram(spark, sf):
    return M.histogram(S.samples(spark, sf).withColumn("latency_ms", F.col("latency_ms") * 5), "operation")


@query("AGG38_bucket_quantile", f"WITH {SAMPLES}, b AS (SELECT scenario, ceil(latency_ms / 10) * 10 AS upper, count(*) AS n FROM samples GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY scenario ORDER BY upper) AS cum, greatest(floor(sum(n) OVER (PARTITION BY scenario) * 0.9), 1) AS want FROM b) SELECT scenario, min(upper) AS quantile FROM c WHERE cum >= want GROUP BY scenario")
def bucket_quantile(spark, sf):
    b = S.samples(spark, sf).groupBy("scenario", (F.ceil(F.col("latency_ms") / 10) * 10).cast("double").alias("upper")).agg(F.count("*").alias("n"))
    return M.bucket_quantile(b, ["scenario"], 0.9)


@query("AGG7_durability_stats", f"WITH {SAMPLES} SELECT operation AS name, count(*) AS n, round(avg(latency_ms), 6) AS mean_ms, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, max(latency_ms) AS max_ms FROM samples WHERE successful GROUP BY operation")
def durability(spark, sf):
    s = S.samples(spark, sf).where("successful")
    return rounded(s.groupBy(F.col("operation").alias("name")).agg(F.count("*").alias("n"), M.mean("latency_ms").alias("mean_ms"), M.percentile("latency_ms", 50).alias("p50_ms"), F.max("latency_ms").alias("max_ms")))


@query("STM1_data_driven_intervals")
def data_driven(spark, sf):
    """Intervals of an hour that the samples themselves open and close."""
    return folds.intervals(S.samples(spark, sf), "scenario", 3_600_000_000)


@query("AGG5_aligned_intervals", f"""WITH {SAMPLES} SELECT scenario, time_bucket(INTERVAL '6 hours', "at", TIMESTAMP '1970-01-01') AS started, count(*) AS total, count(*) FILTER (NOT successful) AS failed, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms FROM samples GROUP BY ALL""")
def aligned(spark, sf):
    return rounded(M.aligned_intervals(S.samples(spark, sf), "scenario", "6 hours"))


@query("FLT12_measured_phase", f"""WITH {SAMPLES} SELECT CASE WHEN "at" < TIMESTAMP '2024-01-03' THEN 'warm_up' WHEN "at" >= TIMESTAMP '2024-01-25' THEN 'late' ELSE 'measured' END AS phase, operation, count(*) AS n FROM samples GROUP BY ALL""")
def phases(spark, sf):
    when = lambda s: F.lit(s).cast("timestamp_ntz")
    return M.measured(S.samples(spark, sf), when("2024-01-03"), when("2024-01-25")).groupBy("phase", "operation").agg(F.count("*").alias("n"))


# --- counters: the even increments are the start snapshot, the odd ones the end, so that some went back

KEYS = ["scenario", "stage", "role", "result"]
_K = ", ".join(KEYS)
DIFF = f"""{COUNTERS}, s0 AS (SELECT {_K}, count(*) AS c, sum(value) AS s FROM counters WHERE seq % 2 = 0 GROUP BY ALL), s1 AS (SELECT {_K}, count(*) AS c, sum(value) AS s FROM counters WHERE seq % 2 = 1 GROUP BY ALL),
diff AS (SELECT {_K}, greatest(s1.c - coalesce(s0.c, 0), 0) AS count, greatest(s1.s - coalesce(s0.s, 0), 0) AS sum FROM s1 LEFT JOIN s0 USING ({_K}))"""
SHARES = """parts AS (SELECT scenario, stage, sum(count) AS count, sum(sum) AS sum FROM diff WHERE result = 'success' GROUP BY ALL),
shares AS (SELECT *, CASE WHEN count = 0 THEN 0 ELSE sum / count * 1000 END AS mean_ms, CASE WHEN sum(sum) OVER w = 0 THEN 0 ELSE sum / sum(sum) OVER w * 100 END AS share, row_number() OVER (PARTITION BY scenario ORDER BY sum DESC, stage) AS rank FROM parts WINDOW w AS (PARTITION BY scenario))"""


def _diff(spark, sf) -> DataFrame:
    c = S.counters(spark, sf)
    return M.snapshot_diff(M.snapshot(c.where("seq % 2 = 1"), KEYS), M.snapshot(c.where("seq % 2 = 0"), KEYS), KEYS)


@query("AGG9_stage_snapshot", f"WITH {COUNTERS} SELECT stage, role, result, count(*) AS count, round(sum(value), 6) AS sum FROM counters GROUP BY ALL")
def stage_snapshot(spark, sf):
    return rounded(M.snapshot(S.counters(spark, sf), ["stage", "role", "result"]))


@query("AGG10_method_snapshot", f"WITH {COUNTERS} SELECT stage, count(*) AS count, round(sum(value), 6) AS sum FROM counters WHERE stage IN ('view', 'click', 'purchase') AND role = 'head' GROUP BY ALL")
def method_snapshot(spark, sf):
    return rounded(M.snapshot(S.counters(spark, sf).where(F.col("stage").isin("view", "click", "purchase") & (F.col("role") == "head")), ["stage"]))


@query("AGG11_grand_total", f"WITH {COUNTERS} SELECT count(*) AS count, round(sum(value), 6) AS sum FROM counters")
def grand_total(spark, sf):
    return rounded(M.snapshot(S.counters(spark, sf), []))


# sums of doubles depend on their order: 1e-9 on both sides lets halves of the last digit round up either way
@query("JON2_snapshot_diff", f"WITH {DIFF} SELECT {_K}, count, round(sum, 6) AS sum, round(CASE WHEN count = 0 THEN 0 ELSE sum / count * 1000 END + 1e-9, 4) AS mean_ms FROM diff")
def snapshot_diff(spark, sf):
    return _diff(spark, sf).withColumn("mean_ms", F.round(M.mean_ms() + 1e-9, 4)).withColumn("sum", F.round("sum", 6))


@query("AGG15_stage_shares", f"WITH {DIFF}, {SHARES} SELECT scenario, stage, CAST(count AS BIGINT) AS count, round(sum, 6) AS sum, round(mean_ms + 1e-9, 4) AS mean_ms, round(share + 1e-9, 4) AS share, rank FROM shares")
def stage_shares(spark, sf):
    out = M.shares(_diff(spark, sf).where("result = 'success'"), ["scenario"], "stage")
    return out.select("scenario", "stage", "count", F.round("sum", 6).alias("sum"), F.round(F.col("mean_ms") + 1e-9, 4).alias("mean_ms"), F.round(F.col("share") + 1e-9, 4).alias("share"), F.col("rank").cast("bigint").alias("rank"))


@query("AGG16_dominant_stage", f"WITH {DIFF}, {SHARES} SELECT scenario, stage AS dominant, share >= 35 AND (coalesce(next, 0) = 0 OR sum >= 1.5 * next) AS clear FROM (SELECT *, lead(sum) OVER (PARTITION BY scenario ORDER BY rank) AS next FROM shares) WHERE rank = 1")
def dominant_stage(spark, sf):
    return M.dominant(M.shares(_diff(spark, sf).where("result = 'success'"), ["scenario"], "stage"), ["scenario"], "stage")


@query("AGG19_record_mix", f"WITH {DIFF}, g AS (SELECT scenario, stage, CAST(sum(count) AS BIGINT) AS records FROM diff WHERE count > 0 GROUP BY ALL) SELECT *, round(records / sum(records) OVER (PARTITION BY scenario) * 100, 4) AS share FROM g")
def record_mix(spark, sf):
    return M.record_mix(_diff(spark, sf), ["scenario"], "stage").withColumn("share", F.round("share", 4))


@query("AGG20_by_shard", f"WITH {COUNTERS} SELECT target AS shard, count(*) AS count, round(sum(value), 6) AS sum, round(sum(value) / count(*) * 1000, 4) AS mean_ms FROM counters WHERE stage = 'click' GROUP BY target")
def by_shard(spark, sf):
    out = M.snapshot(S.counters(spark, sf).where("stage = 'click'").withColumnRenamed("target", "shard"), ["shard"])
    return out.withColumn("mean_ms", F.round(M.mean_ms(), 4)).withColumn("sum", F.round("sum", 6))


@query("AGG14_gauge_max", f"WITH {COUNTERS}, g AS (SELECT CASE WHEN seq % 11 = 0 THEN 'node.prom' WHEN seq % 5 = 0 THEN stage ELSE stage || '@' || target END AS name, value - 0.05 AS value FROM counters) SELECT name, round(max(value), 6) AS value FROM g WHERE value > 0 GROUP BY name")
def gauge_max(spark, sf):
    c = S.counters(spark, sf)
    g = c.select(F.when(F.col("seq") % 11 != 0, F.col("stage")).alias("kind"), F.when(F.col("seq") % 5 != 0, F.col("target")).alias("target"), F.lit("node.prom").alias("file"), (F.col("value") - 0.05).alias("value"))
    return rounded(M.gauge_max(g))


@query("AGG22_experiment", "SELECT coalesce(min(CASE WHEN event_id % 3 = 0 THEN event_type END), 'baseline_json_sync') AS experiment FROM events")
def experiment(spark, sf):
    return M.experiment(S.table(spark, sf, "events").select(F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise("").alias("experiment")))


@query("JON5_storage_floor", f"WITH {SAMPLES}, t AS (SELECT CASE WHEN seq % 7 < 5 THEN 'current' ELSE 'control' END AS path, scenario AS name, latency_ms FROM samples WHERE NOT (seq % 7 >= 5 AND scenario > '2024-01-20')), m AS (SELECT path, name, quantile_cont(latency_ms, 0.5) AS p FROM t GROUP BY ALL) SELECT a.name, round(a.p, 6) AS current_ms, round(coalesce(b.p, 0), 6) AS control_ms, round(CASE WHEN coalesce(b.p, 0) = 0 THEN 0 ELSE a.p / b.p END, 4) AS ratio FROM m a LEFT JOIN m b ON a.name = b.name AND b.path = 'control' WHERE a.path = 'current'")
def storage_floor(spark, sf):
    s = S.samples(spark, sf).select("seq", F.col("scenario").alias("name"), F.col("latency_ms").alias("p50_ms"))
    out = M.storage_floor(s.where("seq % 7 < 5"), s.where("seq % 7 >= 5 and name <= '2024-01-20'"))
    return out.select("name", F.round("current_ms", 6).alias("current_ms"), F.round("control_ms", 6).alias("control_ms"), F.round("ratio", 4).alias("ratio"))


# --- traces: the lines of an order are the stages of a write

STAGES = ["s1", "s2", "s3", "s4", "s5", "s6", "s7"]
PAIRS = {"accept": ("s1", "s2"), "queue": ("s2", "s3"), "flush": ("s3", "s4"), "end_to_end": ("s1", "s7")}
TRACE = """trace AS (SELECT l_orderkey % 16 AS slot, l_orderkey AS sequence, 's' || l_linenumber AS stage, l_shipdate AS "at" FROM lineitem)"""


def _trace(spark, sf) -> DataFrame:
    li = S.table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") % 16).alias("slot"), F.col("l_orderkey").alias("sequence"), F.concat(F.lit("s"), "l_linenumber").alias("stage"), F.col("l_shipdate").alias("at"))


@query("AGG24_earliest_stage", f"""WITH {TRACE} SELECT slot, sequence, {", ".join(f'''min("at") FILTER (stage = '{s}') AS {s}''' for s in STAGES)} FROM trace GROUP BY slot, sequence""")
def earliest(spark, sf):
    return M.earliest(_trace(spark, sf), ["slot", "sequence"], STAGES)


@query("AGG25_trace_durations", f"""WITH {TRACE}, e AS (SELECT slot, sequence, {", ".join(f'''min("at") FILTER (stage = '{s}') AS {s}''' for s in STAGES)} FROM trace GROUP BY slot, sequence), d AS ({" UNION ALL ".join(f"SELECT '{n}' AS name, epoch_us({z}) - epoch_us({a}) AS us FROM e WHERE {z} >= {a}" for n, (a, z) in PAIRS.items())}) SELECT name, count(*) AS samples, round(avg(us / 1000), 3) AS mean_ms FROM d GROUP BY name""")
def durations(spark, sf):
    return rounded(M.durations(M.earliest(_trace(spark, sf), ["slot", "sequence"], STAGES), PAIRS), 3)


@query("JON4_writes_in_scenarios", f"""WITH {SAMPLES}, sc AS (SELECT scenario, min("at") + INTERVAL 1 HOUR AS lo, max("at") + INTERVAL 2 HOUR AS hi FROM samples GROUP BY scenario) SELECT sc.scenario, count(*) AS writes FROM samples s JOIN sc ON s."at" BETWEEN lo AND hi WHERE s.operation = 'put' GROUP BY sc.scenario""")
def writes_in_scenarios(spark, sf):
    s = S.samples(spark, sf)
    sc = s.groupBy("scenario").agg((F.min("at") + F.expr("interval 1 hour")).alias("measured_from"), (F.max("at") + F.expr("interval 2 hours")).alias("measured_to"))
    return M.in_scenarios(s.where("operation = 'put'").drop("scenario"), sc).groupBy("scenario").agg(F.count("*").alias("writes"))


@query("KVO12_trace_lookup", f"""WITH {TRACE}, asked AS (SELECT slot, max(sequence) - 40 AS near FROM trace GROUP BY slot) SELECT slot, sequence, stage, "at" FROM (SELECT t.*, row_number() OVER (PARTITION BY slot ORDER BY sequence DESC, stage DESC) AS r FROM trace t JOIN asked USING (slot) WHERE abs(sequence - near) <= 128 AND stage = 's1') WHERE r <= 32""")
def trace_lookup(spark, sf):
    t = _trace(spark, sf)
    asked = t.groupBy("slot").agg((F.max("sequence") - 40).alias("near"))
    close = t.where("stage = 's1'").join(asked, "slot").where("abs(sequence - near) <= 128")
    return last_n(close, ["slot"], "sequence", 32).select("slot", "sequence", "stage", "at")


ARTIFACTS = """art AS (SELECT event_id AS artifact_id, ts AS "at", 'store-' || (user_id % 3) AS node_id, user_id % 16 AS slot, event_id % 7 + 1 AS sequence,
    CASE WHEN value > 60 THEN 'rpc: context deadline exceeded' WHEN value > 20 THEN 'context canceled' ELSE 'other' END AS error,
    CAST(floor(value / 40) AS BIGINT) % 3 AS next_sequence, user_id % 5 AS highest_committed, event_id % 4 AS slot_durable, CASE WHEN event_id % 2 = 0 THEN event_id % 6 END AS journal_durable,
    event_id % 3 = 0 AS upstream_in_flight, user_id % 4 AS upstream_confirmed, event_id % 5 AS applied, event_id % 3 AS credit, event_id % 4 AS spool, event_id % 8 = 1 AS blocked, event_id % 9 AS sent, event_id % 2 AS acked FROM events WHERE event_type = 'error'),
a AS (SELECT *, CASE WHEN next_sequence > 0 THEN next_sequence WHEN highest_committed > 0 THEN highest_committed + 1 ELSE sequence END AS stuck, greatest(coalesce(journal_durable, 0), slot_durable) AS durable FROM art),
g AS (SELECT node_id, slot, stuck, first(a ORDER BY "at", sequence, artifact_id) AS f, last(a ORDER BY "at", sequence, artifact_id) AS l, count(*) FILTER (error LIKE '%deadline exceeded%') AS deadline_errors, count(*) FILTER (error LIKE '%canceled%') AS canceled FROM a GROUP BY node_id, slot, stuck)"""


def _artifacts(spark, sf) -> DataFrame:
    e = S.table(spark, sf, "events").where("event_type = 'error'")
    session = "array(named_struct('kind', 'forward', 'target', 'next', 'credit', event_id % 3, 'spool', event_id % 4, 'blocked', event_id % 8 = 1, 'sent', event_id % 9, 'acked', event_id % 2)) AS sessions"
    return e.selectExpr(
        "event_id AS artifact_id", "ts AS at", "'store-' || (user_id % 3) AS node_id", "user_id % 16 AS slot", "event_id % 7 + 1 AS sequence",
        "CASE WHEN value > 60 THEN 'rpc: context deadline exceeded' WHEN value > 20 THEN 'context canceled' ELSE 'other' END AS error",
        "CAST(floor(value / 40) AS BIGINT) % 3 AS next_sequence", "user_id % 5 AS highest_committed", "event_id % 4 AS slot_durable", "CASE WHEN event_id % 2 = 0 THEN event_id % 6 END AS journal_durable",
        "event_id % 3 = 0 AS upstream_in_flight", "user_id % 4 AS upstream_confirmed", "event_id % 5 AS applied", session,
    )


@query(
    "AGG26_timeout_roots",
    f"""WITH {ARTIFACTS} SELECT node_id, slot, stuck, f."at" AS first_seen, l."at" AS last_seen, l.highest_committed AS highest_committed, l.durable AS durable, deadline_errors, canceled,
    f.credit <> l.credit AS credit_changed, (f.spool, f.sent, f.acked) IS DISTINCT FROM (l.spool, l.sent, l.acked) AS spool_changed, f.durable <> l.durable AS durable_moved, f.highest_committed <> l.highest_committed OR f.applied <> l.applied AS apply_changed,
    CASE WHEN l.durable >= stuck AND l.highest_committed < stuck THEN 'slot_owner_apply_or_reconcile' WHEN l.spool > 0 AND (l.credit = 0 OR l.blocked) THEN 'sender_spool_or_credit'
         WHEN l.upstream_in_flight AND l.upstream_confirmed < l.highest_committed THEN 'upstream_replay_or_confirm_debt' WHEN l.sent >= stuck AND l.acked < stuck AND l.durable < stuck THEN 'receiver_delivery_or_journal' ELSE 'unknown' END AS likely_stage,
    node_id || '/' || slot || '/' || stuck AS place FROM g""",
)
def timeout_roots(spark, sf):
    return M.timeout_roots(_artifacts(spark, sf))


# --- progress and probes ------------------------------------------------------------------------

PROGRESS = """progress AS (SELECT event_id AS seq, ts AS "at", user_id AS run, 8 AS slots, least(8, event_id % 10) AS writable, event_id % 4 AS readable, event_id % 5 AS pending, event_id % 7 AS outbox, event_id % 3 AS refreshes FROM events)"""


def _progress(spark, sf) -> DataFrame:
    return S.table(spark, sf, "events").selectExpr("event_id AS seq", "ts AS at", "user_id AS run", "8 AS slots", "least(8, event_id % 10) AS writable", "event_id % 4 AS readable", "event_id % 5 AS pending", "event_id % 7 AS outbox", "event_id % 3 AS refreshes")


@query("AGG31_routing_progress", f"""WITH {PROGRESS}, f AS (SELECT run, min(seq) AS s0, max(seq) AS s1, min(seq) FILTER (readable > 0) AS r, min(seq) FILTER (writable = slots) AS w, count(*) AS samples, max(pending) AS max_pending, max(outbox) AS max_outbox, max(refreshes) AS max_refreshes FROM progress GROUP BY run)
    SELECT f.run, samples, (epoch_us(b."at") - epoch_us(a."at")) / 1e6 AS total_s, coalesce((epoch_us(r."at") - epoch_us(a."at")) / 1e6, 0) AS first_readable_s, coalesce((epoch_us(w."at") - epoch_us(a."at")) / 1e6, 0) AS all_writable_s, max_pending, max_outbox, max_refreshes
    FROM f JOIN progress a ON a.seq = s0 JOIN progress b ON b.seq = s1 LEFT JOIN progress r ON r.seq = f.r LEFT JOIN progress w ON w.seq = f.w""")
def routing_progress(spark, sf):
    return M.routing_progress(_progress(spark, sf), ["run"])


@query("FLT11_progress_changes", f"WITH {PROGRESS} SELECT run, seq FROM (SELECT *, lag(seq) OVER w AS p, lag(writable) OVER w AS pw, lag(readable) OVER w AS pr FROM progress WINDOW w AS (PARTITION BY run ORDER BY seq)) WHERE p IS NULL OR writable <> pw OR readable <> pr")
def progress_changes(spark, sf):
    return M.changes(_progress(spark, sf), ["run"], "seq", ["writable", "readable"]).select("run", "seq")


@query("WIN18_stalls", f"WITH {PROGRESS}, b AS (SELECT *, row_number() OVER w AS i, max(writable) OVER (PARTITION BY run ORDER BY seq) AS best, coalesce(writable > max(writable) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM progress WINDOW w AS (PARTITION BY run ORDER BY seq)) SELECT run, seq, CAST(best AS BIGINT) AS best, improved, i - max(CASE WHEN improved THEN i END) OVER (PARTITION BY run ORDER BY seq) AS stalled FROM b")
def stalls(spark, sf):
    return M.stalls(_progress(spark, sf), ["run"], "seq", "writable").select("run", "seq", F.col("best").cast("bigint").alias("best"), "improved", F.col("stalled").cast("bigint").alias("stalled"))


@query("WIN19_polyline", f"""WITH {SAMPLES} SELECT scenario, seq, round(CASE WHEN count(*) OVER w > 1 THEN 640.0 * (row_number() OVER (PARTITION BY scenario ORDER BY seq) - 1) / greatest(count(*) OVER w - 1, 1) ELSE 0 END, 4) AS x, round(120 - 120 * latency_ms / CASE WHEN max(latency_ms) OVER w = 0 THEN 1 ELSE max(latency_ms) OVER w END, 4) AS y FROM samples WINDOW w AS (PARTITION BY scenario)""")
def polyline(spark, sf):
    out = M.polyline(S.samples(spark, sf), ["scenario"], "seq", "latency_ms", 640.0, 120.0)
    return out.select("scenario", "seq", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


PROBES = """probes AS (SELECT user_id AS node, event_id AS seq, ts AS "at", event_id * 60 AS idle, event_id * 100 + CAST(floor(value) AS BIGINT) % 50 AS total, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
nets AS (SELECT node, seq, i, unnest(CASE WHEN seq % 3 = 0 THEN ['eth0'] ELSE ['eth0', 'eth1'] END) AS name FROM probes),
net AS (SELECT *, CASE WHEN name = 'eth0' THEN seq * 900000 ELSE seq * 700000 % 50000000 END AS rx, seq * 300000 AS tx FROM nets)"""


@query("WIN4_host_rates", f"""WITH {PROBES}, d AS (SELECT c.node, c.seq, (epoch_us(c."at") - epoch_us(p."at")) / 1e6 AS seconds, c.idle - p.idle AS idle, c.total - p.total AS total, c.i FROM probes c JOIN probes p ON p.node = c.node AND p.i = c.i - 1),
    moved AS (SELECT c.node, c.i, sum(greatest(c.rx - coalesce(p.rx, 0), 0)) AS rx, sum(greatest(c.tx - coalesce(p.tx, 0), 0)) AS tx FROM net c LEFT JOIN net p ON p.node = c.node AND p.i = c.i - 1 AND p.name = c.name GROUP BY c.node, c.i)
    SELECT 'node-' || d.node AS node_id, d.seq, seconds, round(CASE WHEN total > 0 THEN 100.0 * (1 - idle / total) ELSE 0 END, 4) AS cpu_percent, round(rx / seconds / 1024 / 1024, 4) AS rx_mb_s, round(tx / seconds / 1024 / 1024, 4) AS tx_mb_s FROM d JOIN moved m ON m.node = d.node AND m.i = d.i WHERE seconds > 0""")
def host_rates(spark, sf):
    r = M.host_rates(S.probes(spark, sf))
    return r.select("node_id", "seq", "seconds", *[F.round(c, 4).alias(c) for c in ("cpu_percent", "rx_mb_s", "tx_mb_s")])


@query("SRT7_metric_rows", f"WITH {COUNTERS} SELECT stage || '@' || target AS name, printf('%s = %.3f', stage || '@' || target, max(value)) AS row FROM counters GROUP BY stage, target")
def metric_rows(spark, sf):
    c = S.counters(spark, sf)
    return M.metric_rows(c.groupBy(F.concat("stage", F.lit("@"), "target").alias("name")).agg(F.max("value").alias("value")))


@query("SRT11_file_tail", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5")
def file_tail(spark, sf):
    return last_n(S.table(spark, sf, "events"), ["user_id"], "event_id", 5).select("user_id", "event_id")


@query("SET1_series_union", "SELECT event_id, 'a' AS node FROM events WHERE user_id % 2 = 0 UNION ALL SELECT event_id, 'b' FROM events WHERE user_id % 2 = 1")
def series_union(spark, sf):
    e = S.table(spark, sf, "events")
    part = lambda k, n: e.where(F.col("user_id") % 2 == k).select("event_id", F.lit(n).alias("node"))
    return part(0, "a").unionByName(part(1, "b"))


@query("TEL5_manifest_verify", "SELECT 'f' || event_id AS path, CASE WHEN event_id % 10 = 3 THEN 'missing' WHEN event_id % 7 = 1 THEN 'size' WHEN event_id % 5 = 2 THEN 'checksum' END AS problem FROM events")
def manifest_verify(spark, sf):
    e = S.table(spark, sf, "events").withColumn("path", F.concat(F.lit("f"), "event_id"))
    listed = e.select("path", F.length("props").alias("size"), F.sha2("props", 256).alias("sha256"))
    found = e.where("event_id % 10 <> 3").select("path", (F.length("props") + (F.col("event_id") % 7 == 1).cast("int")).alias("size"), F.sha2(F.concat("props", F.when(F.col("event_id") % 5 == 2, "x").otherwise("")), 256).alias("sha256"))
    return M.verify_manifest(listed, found)
