"""Queries of operators that are also parts of others: each by itself."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.functions.conditions import compare
from keelson.functions.hashing import sampled
from keelson.operators import control as C
from keelson.operators import log as L
from keelson.operators import telemetry as M
from keelson.plans import control as PC
from keelson.plans import telemetry as PT
from keelson.plans.control import ASSIGNED, BEATS, FACTOR, REPLICAS, ROUTES
from keelson.plans.log import LOG, OPS, _log
from keelson.plans.names import query
from keelson.plans.telemetry import ARTIFACTS, COUNTERS, DIFF, PROBES, SAMPLES, TRACE
from keelson.sources import tables as S

# --- conditions and reads

_OPS = ["eq", "lt", "lte", "gt", "gte", "odd"]
_NAMED = "['eq', 'lt', 'lte', 'gt', 'gte', 'odd'][CAST(event_id % 6 AS INTEGER) + 1]"


@query("FLT2_compare_numbers", f"SELECT event_id, CASE {_NAMED} WHEN 'eq' THEN user_id % 5 = event_id % 5 WHEN 'lt' THEN user_id % 5 < event_id % 5 WHEN 'lte' THEN user_id % 5 <= event_id % 5 WHEN 'gt' THEN user_id % 5 > event_id % 5 WHEN 'gte' THEN user_id % 5 >= event_id % 5 ELSE false END AS holds FROM events")
def compare_numbers(spark, sf):
    k = F.col("event_id")
    op = F.array(*[F.lit(x) for x in _OPS])[(k % 6).cast("int")]
    return S.table(spark, sf, "events").select("event_id", compare(op, F.col("user_id") % 5, k % 5).alias("holds"))


@query("FLT3_compare_times", f"SELECT event_id, CASE {_NAMED} WHEN 'eq' THEN ts = TIMESTAMP '2024-01-15' WHEN 'lt' THEN ts < TIMESTAMP '2024-01-15' WHEN 'lte' THEN ts <= TIMESTAMP '2024-01-15' WHEN 'gt' THEN ts > TIMESTAMP '2024-01-15' WHEN 'gte' THEN ts >= TIMESTAMP '2024-01-15' ELSE false END AS holds FROM events")
def compare_times(spark, sf):
    op = F.array(*[F.lit(x) for x in _OPS])[(F.col("event_id") % 6).cast("int")]
    return S.table(spark, sf, "events").select("event_id", compare(op, F.col("ts"), F.lit("2024-01-15").cast("timestamp_ntz")).alias("holds"))


@query("API1_linearizable_get", f"{LOG}, asked AS (SELECT DISTINCT slot, key FROM ops WHERE arrival % 5 = 0), s AS (SELECT slot, key, kind, value, version, row_number() OVER (PARTITION BY slot, key ORDER BY sequence DESC) AS r FROM log WHERE sequence % 4 <> 3 OR arrival % 2 = 0) SELECT a.slot, a.key, coalesce(kind = 'put', false) AS found, CASE WHEN kind = 'put' THEN value END AS value, CASE WHEN kind = 'put' THEN version END AS version FROM asked a LEFT JOIN s ON s.slot = a.slot AND s.key = a.key AND r = 1")
def linearizable_get(spark, sf):
    """What the tail has committed of asked keys; here it lacks some operations."""
    there = _log(spark, sf).where("sequence % 4 <> 3 or arrival % 2 = 0")
    asked = S.operations(spark, sf).where("arrival % 5 = 0").select("slot", "key").distinct()
    return L.point_get(L.state(there), asked)


@query("API2_get_with_consistency", f"{LOG}, c AS (SELECT slot, CAST(floor(max(sequence) * 0.6) AS BIGINT) AS here, CAST(floor(max(sequence) * 0.8) AS BIGINT) AS tail FROM log GROUP BY slot), asked AS (SELECT DISTINCT slot, key, slot % 2 = 0 AS strict FROM ops), s AS (SELECT log.slot, key, kind, value, row_number() OVER (PARTITION BY log.slot, key ORDER BY sequence DESC) AS r FROM log JOIN c USING (slot) WHERE sequence <= CASE WHEN log.slot % 2 = 0 THEN tail ELSE here END) SELECT a.slot, a.key, strict, coalesce(kind = 'put', false) AS found, CASE WHEN kind = 'put' THEN value END AS value FROM asked a LEFT JOIN s ON s.slot = a.slot AND s.key = a.key AND r = 1")
def get_with_consistency(spark, sf):
    """Strict reads see what the tail has committed, local ones what this replica has."""
    log = _log(spark, sf)
    top = log.groupBy("slot").agg(F.max("sequence").alias("top"))
    seen = F.when(F.col("slot") % 2 == 0, F.floor(F.col("top") * 0.8)).otherwise(F.floor(F.col("top") * 0.6))
    objects = L.state(log.join(top, "slot").where(F.col("sequence") <= seen))
    asked = S.operations(spark, sf).select("slot", "key").distinct()
    return L.point_get(objects, asked).select("slot", "key", (F.col("slot") % 2 == 0).alias("strict"), "found", "value")


@query("API13_committed_snapshot", f"{LOG}, l AS (SELECT *, row_number() OVER (PARTITION BY slot, key ORDER BY sequence DESC) AS r FROM log) SELECT slot, max(sequence) AS committed, count(*) FILTER (r = 1 AND kind = 'put') AS objects FROM l GROUP BY slot")
def committed_snapshot(spark, sf):
    newest = L.latest(_log(spark, sf))
    return newest.groupBy("slot").agg(F.max("sequence").alias("committed"), F.count_if(F.col("kind") == "put").alias("objects"))


@query("PRJ2_next_metadata", f"{LOG} SELECT arrival, version, created_at, updated_at FROM log WHERE kind = 'put'")
def next_metadata(spark, sf):
    return _log(spark, sf).where("kind = 'put'").select("arrival", "version", "created_at", "updated_at")


@query("SRT8_sorted_snapshot", f"{LOG}, l AS (SELECT *, row_number() OVER (PARTITION BY slot, key ORDER BY sequence DESC) AS r FROM log) SELECT slot, key, row_number() OVER (PARTITION BY slot ORDER BY key) AS place FROM l WHERE r = 1 AND kind = 'put'")
def sorted_snapshot(spark, sf):
    """Entries of a slot's snapshot by key; one user's key each, so a window holds distinct keys only."""
    objects = L.state(_log(spark, sf))
    return objects.select("slot", "key", F.row_number().over(W.partitionBy("slot").orderBy("key")).cast("bigint").alias("place"))


@query("SNK3_installed_snapshot", f"{LOG}, c AS (SELECT slot, max(sequence) // 2 AS half FROM log GROUP BY slot), l AS (SELECT log.*, row_number() OVER (PARTITION BY log.slot, key ORDER BY sequence DESC) AS r FROM log JOIN c USING (slot) WHERE CASE WHEN log.slot % 2 = 0 THEN sequence <= half ELSE true END) SELECT slot, count(*) FILTER (r = 1 AND kind = 'put') AS objects, max(sequence) AS sequence FROM l GROUP BY slot")
def installed_snapshot(spark, sf):
    """Even slots install a snapshot of half their log in place of all they had; what was staged goes."""
    log = _log(spark, sf)
    half = log.groupBy("slot").agg(F.floor(F.max("sequence") / 2).alias("half"))
    snapshot = L.latest(log.join(half, "slot").where("slot % 2 = 0 and sequence <= half"))
    now = L.latest(log).join(snapshot.select("slot").distinct(), "slot", "left_anti").unionByName(snapshot)
    return now.groupBy("slot").agg(F.count_if(F.col("kind") == "put").alias("objects"), F.max("sequence").alias("sequence"))


@query("SNK4_high_water_mark", f"{LOG}, c AS (SELECT slot, max(sequence) // 2 AS mark FROM log GROUP BY slot) SELECT slot, mark AS committed, mark AS confirmed, CAST(0 AS BIGINT) AS staged FROM c")
def high_water_mark(spark, sf):
    """A mark set from outside is the committed and the confirmed cursor, and nothing stays staged."""
    top = _log(spark, sf).groupBy("slot").agg(F.floor(F.max("sequence") / 2).alias("mark"))
    return top.select("slot", F.col("mark").alias("committed"), F.col("mark").alias("confirmed"), F.lit(0).cast("bigint").alias("staged"))


@query("SNK5_staged_operations", f"{LOG}, t AS (SELECT slot, sequence, kind, arrival FROM log UNION ALL SELECT slot, sequence, kind, arrival + 1000000000 FROM log WHERE arrival % 6 = 1) SELECT slot, sequence, arrival, CASE WHEN row_number() OVER (PARTITION BY slot, sequence ORDER BY arrival) = 1 THEN 'staged' ELSE 'duplicate' END AS outcome FROM t")
def staged_operations(spark, sf):
    log = _log(spark, sf).select("slot", "sequence", "arrival")
    again = log.where("arrival % 6 = 1").withColumn("arrival", F.col("arrival") + 1_000_000_000)
    nth = F.row_number().over(W.partitionBy("slot", "sequence").orderBy("arrival"))
    return log.unionByName(again).select("slot", "sequence", "arrival", F.when(nth == 1, "staged").otherwise("duplicate").alias("outcome"))


# --- routes, chains and recovery

@query("FLT5_read_check", f"WITH {ASSIGNED} SELECT o_orderkey, CASE WHEN a.slot IS NULL THEN 'unknown_slot' WHEN state <> 'active' THEN 'inactive' WHEN o_orderkey % 5 = 0 THEN 'wrong_version' END AS refused FROM orders LEFT JOIN assigned a ON a.slot = o_custkey * 2 AND a.pos = o_orderkey % 3")
def read_check(spark, sf):
    return PC.write_check(spark, sf).select("o_orderkey", F.col("read_refused").alias("refused"))


@query("FLT6_route_flags", f"WITH {ROUTES} SELECT slot, readable, writable FROM routes")
def route_flags(spark, sf):
    return PC._routes(spark, sf).select("slot", "readable", "writable")


@query("PLN18_serving_chain", f"WITH {ROUTES} SELECT slot, serving FROM routes WHERE serving > 0")
def serving_chain(spark, sf):
    return PC._routes(spark, sf).select("slot", F.size("read_replicas").cast("bigint").alias("serving")).where("serving > 0")


@query("PLN17_fallback_chain", f"WITH {REPLICAS} SELECT slot, string_agg(node_id, ',' ORDER BY pos) FILTER (state <> 'joining') AS serving FROM replicas GROUP BY slot HAVING count(*) FILTER (state <> 'joining') > 0")
def fallback_chain(spark, sf):
    """While peers are refreshed a slot is served by those that were there before: all but the joining."""
    before = F.transform(F.filter("chain", lambda r: r["state"] != "joining"), lambda r: r["node_id"])
    return C.chains(S.replicas(spark, sf)).select("slot", before.alias("s")).where(F.size("s") > 0).select("slot", F.array_join("s", ",").alias("serving"))


@query("JON8_chain_endpoints", f"WITH {REPLICAS} SELECT slot, pos, node_id, '10.0.0.' || n AS endpoint FROM replicas")
def chain_endpoints(spark, sf):
    return S.replicas(spark, sf).join(S.nodes(spark, sf).select("node_id", F.col("rpc_address").alias("endpoint")), "node_id").select("slot", "pos", "node_id", "endpoint")


@query("WIN7_chain_neighbours", f"WITH {ASSIGNED} SELECT slot, pos, predecessor, successor FROM assigned")
def chain_neighbours(spark, sf):
    return C.assignments(S.replicas(spark, sf)).select("slot", "pos", "predecessor", "successor")


@query("WIN8_active_ends", f"WITH {REPLICAS} SELECT slot, arg_min(node_id, pos) AS first, arg_max(node_id, pos) AS last FROM replicas WHERE state = 'active' GROUP BY slot")
def active_ends(spark, sf):
    return S.replicas(spark, sf).where("state = 'active'").groupBy("slot").agg(F.min_by("node_id", "pos").alias("first"), F.max_by("node_id", "pos").alias("last"))


@query("AGG36_chain_counts", f"WITH {REPLICAS} SELECT slot, count(*) AS replicas, count(*) FILTER (state = 'active') AS active FROM replicas GROUP BY slot")
def chain_counts(spark, sf):
    return S.replicas(spark, sf).groupBy("slot").agg(F.count("*").alias("replicas"), F.count_if(F.col("state") == "active").alias("active"))


@query("JON9_domain_conflict", f"WITH {REPLICAS}, m AS (SELECT slot, nation, region FROM replicas JOIN nodes USING (node_id)), asked AS (SELECT p_partkey AS slot, 'Supplier#' || lpad(CAST(p_partkey % 10 + 1 AS VARCHAR), 9, '0') AS node_id FROM part) SELECT a.slot, bool_or(coalesce(m.nation = n.nation OR m.region = n.region, false)) AS conflict FROM asked a JOIN nodes n USING (node_id) LEFT JOIN m USING (slot) GROUP BY a.slot")
def domain_conflict(spark, sf):
    """Whether a slot's candidate shares a failure domain with a member of its chain: one candidate a slot, a chain is short."""
    nodes = S.nodes(spark, sf).select("node_id", "domains")
    candidate = F.concat(F.lit("Supplier#"), F.lpad((F.col("p_partkey") % 10 + 1).cast("string"), 9, "0"))
    asked = S.table(spark, sf, "part").select(F.col("p_partkey").alias("slot"), candidate.alias("node_id")).join(nodes, "node_id").select("slot", "domains")
    members = S.replicas(spark, sf).join(nodes, "node_id").select("slot", F.col("domains").alias("theirs"))
    shared = F.exists(F.map_entries("domains"), lambda e: F.try_element_at("theirs", e["key"]) == e["value"])
    return asked.join(members, "slot", "left").groupBy("slot").agg(F.bool_or(F.coalesce(shared, F.lit(False))).alias("conflict"))


@query("JON7_recovery_source", f"WITH {ASSIGNED} SELECT slot, node_id, coalesce(predecessor, successor) AS source FROM assigned")
def recovery_source(spark, sf):
    return C.assignments(S.replicas(spark, sf)).select("slot", "node_id", F.coalesce("predecessor", "successor").alias("source"))


@query("FLT13_resumable", f"WITH {ASSIGNED} SELECT slot, node_id, role IN ('tail', 'single') AND slot % 4 <> 0 AND slot % 5 <> 0 AS resumable FROM assigned")
def resumable(spark, sf):
    has_data, was_active = F.col("slot") % 4 != 0, F.col("slot") % 5 != 0
    return C.assignments(S.replicas(spark, sf)).select("slot", "node_id", (F.col("role").isin("tail", "single") & has_data & was_active).alias("resumable"))


@query("LIF11_recovered_inventory", f"WITH {REPLICAS} SELECT node_id, string_agg(slot, ',' ORDER BY slot) AS slots FROM replicas WHERE slot % 3 = 1 GROUP BY node_id")
def recovered_inventory(spark, sf):
    """What each node reports, by slot; a report is one message of one node."""
    slots = F.transform(F.sort_array(F.collect_list("slot")), lambda s: s.cast("string"))
    return S.replicas(spark, sf).where("slot % 3 = 1").groupBy("node_id").agg(F.array_join(slots, ",").alias("slots"))


@query("LIF5_resumed_cursors", f"{LOG}, c AS (SELECT slot, max(sequence) AS top, CAST(floor(max(sequence) * 0.9) AS BIGINT) AS prepared, CAST(floor(max(sequence) * 0.8) AS BIGINT) AS tail FROM log GROUP BY slot) SELECT slot, least(prepared, tail) AS committed, prepared - least(prepared, tail) AS replays FROM c")
def resumed_cursors(spark, sf):
    """A replica that resumes has committed what the tail has of what it has prepared; the rest is replayed."""
    c = _log(spark, sf).groupBy("slot").agg(F.max("sequence").alias("top"))
    prepared, tail = F.floor(F.col("top") * 0.9), F.floor(F.col("top") * 0.8)
    return c.select("slot", F.least(prepared, tail).alias("committed"), (prepared - F.least(prepared, tail)).alias("replays"))


@query("LIF10_replayed_prepared", f"{LOG}, h AS (SELECT slot, sequence FROM log WHERE arrival % 37 <> 20), c AS (SELECT slot, CAST(floor(max(sequence) * 0.6) AS BIGINT) AS committed FROM log GROUP BY slot), r AS (SELECT h.slot, sequence, committed, row_number() OVER (PARTITION BY h.slot ORDER BY sequence) AS k FROM h JOIN c USING (slot) WHERE sequence > committed) SELECT slot, sequence FROM r WHERE sequence = committed + k")
def replayed_prepared(spark, sf):
    """Prepared operations above what is committed, in order, up to the first that is missing."""
    log = _log(spark, sf)
    cut = log.groupBy("slot").agg(F.floor(F.max("sequence") * 0.6).alias("materialized"))
    return L.to_materialize(log.where("arrival % 37 <> 20").select("slot", "sequence"), cut).where("action = 'apply'").select("slot", "sequence")


@query("LIF2_mark_leaving", f"WITH {REPLICAS} SELECT slot, pos, CASE WHEN state IN ('active', 'leaving') THEN 'leaving' END AS next FROM replicas")
def mark_leaving(spark, sf):
    return C.lifecycle(S.replicas(spark, sf).select("slot", "pos", F.lit("leave").alias("step"), "state")).select("slot", "pos", "next")


@query("LIF3_remove_leaving", f"WITH {REPLICAS} SELECT slot, pos, CASE WHEN state = 'leaving' THEN 'removed' END AS next FROM replicas")
def remove_leaving(spark, sf):
    return C.lifecycle(S.replicas(spark, sf).select("slot", "pos", F.lit("remove").alias("step"), "state")).select("slot", "pos", "next")


@query("SRT2_replica_candidate", f"WITH {REPLICAS}, e AS (SELECT *, min(pos) OVER s AS a, max(pos) OVER s AS z FROM replicas WINDOW s AS (PARTITION BY slot)), l AS (SELECT node_id, count(*) FILTER (pos = a) AS heads, count(*) FILTER (pos = z) AS tails, count(*) AS replicas FROM e GROUP BY node_id) SELECT slot, node_id FROM (SELECT r.slot, l.node_id, row_number() OVER (PARTITION BY r.slot ORDER BY tails, heads, replicas, l.node_id) AS k FROM replicas r JOIN l USING (node_id) WHERE r.state = 'active' AND r.n % 4 <> 1) WHERE k = 1")
def replica_candidate(spark, sf):
    """Of the eligible candidates (active, not draining) the least loaded."""
    r = S.replicas(spark, sf)
    return C.best_candidates(r.where("state = 'active' and n % 4 <> 1").select("slot", "node_id"), C.load(r))


@query("SRT4_change_budget", f"WITH {REPLICAS} SELECT slot, count(*) AS replicas FROM replicas GROUP BY slot")
def change_budget(spark, sf):
    """A budget of none is no limit."""
    return C.budgeted(S.replicas(spark, sf).groupBy("slot").agg(F.count("*").alias("replicas")), 0, True)


@query("SRT6_outbox_order", "SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_clerk, o_orderkey) AS place FROM (SELECT *, o_orderkey % 3 AS o_clerk FROM orders)")
def outbox_order(spark, sf):
    """Entries by slot, kind, node and id; a slot's entries are its own few."""
    o = S.table(spark, sf, "orders").withColumn("node", F.col("o_orderkey") % 3)
    return o.select(F.col("o_orderkey").alias("id"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderstatus", "node", "o_orderkey")).cast("bigint").alias("place"))


@query("JON12_unacknowledged", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 0")
def unacknowledged(spark, sf):
    o = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return o.join(o.where("id % 4 = 0"), "id", "left_anti")


@query("JON16_removed_reports", "SELECT o_orderkey AS report_id, CASE WHEN c_custkey IS NULL THEN 'no_pending' WHEN o_orderkey % 5 = 0 THEN 'wrong_node' WHEN o_orderkey % 3 = 0 THEN 'wrong_version' ELSE 'accepted' END AS outcome FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) c ON c_custkey = o_custkey")
def removed_reports(spark, sf):
    k = F.col("o_orderkey")
    reports = S.table(spark, sf, "orders").select(k.alias("report_id"), F.col("o_custkey").alias("slot"), F.lit("removed").alias("kind"), F.when(k % 5 == 0, "b").otherwise("a").alias("node_id"), F.lit("c1").alias("command_id"), F.when(k % 3 == 0, 2).otherwise(1).alias("version"))
    pending = S.table(spark, sf, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("slot"), F.lit("removed").alias("kind"), F.lit("a").alias("node_id"), F.lit("c1").alias("command_id"), F.lit(1).alias("version"))
    return C.report_outcome(reports, pending)


# --- liveness

@query("WIN16_suspect_edges", f"WITH {BEATS} SELECT node_id, seq FROM (SELECT *, lag(state) OVER (PARTITION BY node_id ORDER BY seq) AS b FROM beats) WHERE state = 'suspect' AND coalesce(b, '') <> 'suspect'")
def suspect_edges(spark, sf):
    return C.flaps(S.heartbeats(spark, sf), 259_200).select("node_id", "seq")


@query("STM2_flap_window", f"""WITH {BEATS}, t AS (SELECT * FROM (SELECT *, lag(state) OVER (PARTITION BY node_id ORDER BY seq) AS b FROM beats) WHERE state = 'suspect' AND coalesce(b, '') <> 'suspect') SELECT node_id, seq, count(*) OVER (PARTITION BY node_id ORDER BY epoch_us("at") RANGE BETWEEN 30000000 PRECEDING AND CURRENT ROW) AS flaps FROM t""")
def flap_window(spark, sf):
    return C.flaps(S.heartbeats(spark, sf), 30).select("node_id", "seq", "flaps")


@query("RUN11_ready_flag", f"WITH {BEATS} SELECT node_id, bool_or(state <> 'dead') AND NOT bool_or(state = 'dead') AS ready FROM beats GROUP BY node_id")
def ready_flag(spark, sf):
    return C.node_fold(S.heartbeats(spark, sf)).select("node_id", "ready")


@query("STM6_fresh_heartbeats", f"WITH {BEATS} SELECT node_id, max(seq) AS seq, arg_max(state, seq) AS state FROM beats GROUP BY node_id")
def fresh_heartbeats(spark, sf):
    return S.heartbeats(spark, sf).groupBy("node_id").agg(F.max("seq").alias("seq"), F.max_by("state", "seq").alias("state"))


@query("WIN10_ring_buffer", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 64")
def ring_buffer(spark, sf):
    return L.last_n(S.table(spark, sf, "events"), ["user_id"], "event_id", 64).select("user_id", "event_id")


# --- statistics and telemetry

_Q = "round(quantile_cont(latency_ms, {p}), 6)"


@query("AGG1_exact_percentile", f"WITH {SAMPLES} SELECT scenario, {_Q.format(p=0.1)} AS p10, {_Q.format(p=0.5)} AS p50, {_Q.format(p=0.999)} AS p999 FROM samples GROUP BY scenario")
def exact_percentile(spark, sf):
    s = S.samples(spark, sf).groupBy("scenario")
    return PT.rounded(s.agg(*[M.percentile("latency_ms", p).alias(n) for p, n in ((10, "p10"), (50, "p50"), (99.9, "p999"))]))


@query("AGG8_mean", f"WITH {SAMPLES} SELECT scenario, round(coalesce(avg(latency_ms) FILTER (NOT successful), 0), 6) AS mean_ms FROM samples GROUP BY scenario")
def mean(spark, sf):
    failed = F.when(~F.col("successful"), F.col("latency_ms"))
    return PT.rounded(S.samples(spark, sf).groupBy("scenario").agg(M.mean(failed).alias("mean_ms")))


@query("AGG12_clamped_delta", f"WITH {DIFF} SELECT scenario, stage, role, result, count, round(sum, 6) AS sum FROM diff")
def clamped_delta(spark, sf):
    return PT._diff(spark, sf).withColumn("sum", F.round("sum", 6))


@query("SRT5_stage_parts", f"WITH {COUNTERS}, p AS (SELECT stage, role, result, count(*) AS count FROM counters GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY count DESC, stage, role, result) AS place FROM p")
def stage_parts(spark, sf):
    """Parts by count, then stage, role and result: a handful of rows, as many as there are kinds."""
    p = S.counters(spark, sf).groupBy("stage", "role", "result").agg(F.count("*").alias("count"))
    return p.withColumn("place", F.row_number().over(W.orderBy(F.desc("count"), "stage", "role", "result")).cast("bigint"))


@query("AGG23_median_of_medians", f"WITH {SAMPLES}, m AS (SELECT scenario AS name, seq % 3 AS node, quantile_cont(latency_ms, 0.5) AS p50 FROM samples GROUP BY ALL) SELECT name, round(quantile_cont(p50, 0.5), 6) AS median_ms FROM m GROUP BY name")
def median_of_medians(spark, sf):
    per = S.samples(spark, sf).groupBy(F.col("scenario").alias("name"), (F.col("seq") % 3).alias("node")).agg(M.percentile("latency_ms", 50).alias("p50"))
    return PT.rounded(per.groupBy("name").agg(M.percentile("p50", 50).alias("median_ms")))


def _method(spark, sf):
    return S.counters(spark, sf).where("role = 'head'").select("scenario", "seq", F.col("stage").alias("method"), "value")


_METHODS = f"{COUNTERS}, s0 AS (SELECT scenario, stage, count(*) AS c FROM counters WHERE role = 'head' AND seq % 2 = 0 GROUP BY ALL), s1 AS (SELECT scenario, stage, count(*) AS c FROM counters WHERE role = 'head' AND seq % 2 = 1 GROUP BY ALL)"


@query("JON3_method_diff", f"WITH {_METHODS} SELECT scenario, stage AS method, greatest(s1.c - coalesce(s0.c, 0), 0) AS count FROM s1 LEFT JOIN s0 USING (scenario, stage)")
def method_diff(spark, sf):
    m, keys = _method(spark, sf), ["scenario", "method"]
    return M.snapshot_diff(M.snapshot(m.where("seq % 2 = 1"), keys), M.snapshot(m.where("seq % 2 = 0"), keys), keys).select("scenario", "method", "count")


# journals: the target is the shard, the role the experiment
_FLUSH = f"{COUNTERS}, k0 AS (SELECT stage, target, result, role, count(*) AS c, sum(CAST(round(value * 1000000) AS BIGINT)) AS s FROM counters WHERE seq % 2 = 0 GROUP BY ALL), k1 AS (SELECT stage, target, result, role, count(*) AS c, sum(CAST(round(value * 1000000) AS BIGINT)) AS s FROM counters WHERE seq % 2 = 1 GROUP BY ALL), kd AS (SELECT stage, target, result, role, greatest(k1.c - coalesce(k0.c, 0), 0) AS count, greatest(k1.s - coalesce(k0.s, 0), 0) AS sum FROM k1 LEFT JOIN k0 USING (stage, target, result, role))"


def _flush(spark, sf):
    """Differences of journal histograms by stage, shard, result and experiment; sums are whole microseconds."""
    keys = ["stage", "shard", "result", "experiment"]
    c = S.counters(spark, sf).select("seq", "stage", F.col("target").alias("shard"), "result", F.col("role").alias("experiment"), F.round(F.col("value") * 1_000_000).cast("bigint").alias("value"))
    snap = lambda k: M.snapshot(c.where(F.col("seq") % 2 == k), keys)
    return M.snapshot_diff(snap(1), snap(0), keys)


@query("AGG21_journal_loaders", f"WITH {_FLUSH} SELECT stage, target AS shard, result, role AS experiment, count, CAST(sum AS BIGINT) AS sum FROM kd")
def journal_loaders(spark, sf):
    return _flush(spark, sf).withColumn("sum", F.col("sum").cast("bigint"))


@query("AGG17_journal_stages", f"WITH {_FLUSH}, a AS (SELECT stage, sum(count) AS count, sum(sum) AS sum FROM kd WHERE result = 'success' AND NOT (count = 0 AND sum = 0) GROUP BY stage) SELECT stage, CAST(count AS BIGINT) AS count, round(CASE WHEN count > 0 THEN sum / count / 1000 ELSE 0 END, 3) AS mean_ms, round(CASE WHEN sum(sum) OVER () > 0 THEN sum * 100 / sum(sum) OVER () ELSE 0 END, 3) AS share, row_number() OVER (ORDER BY sum DESC, stage) AS rank FROM a")
def journal_stages(spark, sf):
    """Stages of successful flushes by their share of all time; differences of nothing are dropped."""
    a = _flush(spark, sf).where("result = 'success' and not (count = 0 and sum = 0)").groupBy("stage").agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"))
    all_ = W.partitionBy()  # a row a stage
    total = F.sum("sum").over(all_)
    mean_ms, share = F.when(F.col("count") > 0, F.col("sum") / F.col("count") / 1000).otherwise(0.0), F.when(total > 0, F.col("sum") * 100 / total).otherwise(0.0)
    rank = F.row_number().over(W.orderBy(F.desc("sum"), "stage")).cast("bigint")
    return a.select("stage", "count", F.round(mean_ms, 3).alias("mean_ms"), F.round(share, 3).alias("share"), rank.alias("rank"))


@query("AGG18_batch_mean", f"WITH {_FLUSH} SELECT stage AS name, CAST(sum(count) AS BIGINT) AS count, round(CASE WHEN sum(count) > 0 THEN sum(sum) / sum(count) ELSE 0 END, 2) AS mean FROM kd WHERE role = 'head' GROUP BY stage")
def batch_mean(spark, sf):
    """Means of one experiment's batches."""
    d = _flush(spark, sf).where("experiment = 'head'").groupBy(F.col("stage").alias("name")).agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"))
    return d.select("name", "count", F.round(F.when(F.col("count") > 0, F.col("sum") / F.col("count")).otherwise(0.0), 2).alias("mean"))


@query("TEL1_put_summary", f"WITH {SAMPLES}, o AS (SELECT scenario, count(*) AS n, count(*) FILTER (NOT successful) AS failed FROM samples WHERE operation = 'put' GROUP BY scenario), w AS (SELECT scenario, count(*) AS n, count(*) FILTER (NOT successful) AS failed, CASE WHEN day(min(\"at\")) % 2 = 0 THEN 'put' ELSE 'mixed' END AS kind, day(min(\"at\")) % 3 = 0 AS listed FROM samples GROUP BY scenario) SELECT scenario, CASE WHEN listed AND o.n IS NOT NULL THEN o.n ELSE w.n END AS total_ops, CASE WHEN listed AND o.n IS NOT NULL THEN o.failed ELSE w.failed END AS error_ops FROM w LEFT JOIN o USING (scenario) WHERE (listed AND o.n IS NOT NULL) OR kind = 'put'")
def put_summary(spark, sf):
    """The put operation's own summary if a scenario lists one, else the whole scenario's if that is of puts, else none."""
    s = S.samples(spark, sf)
    count = lambda df, a, b: df.groupBy("scenario").agg(F.count("*").alias(a), F.count_if(~F.col("successful")).alias(b), F.day(F.min("at")).alias("d"))
    own = count(s.where("operation = 'put'"), "own", "own_failed").drop("d")
    w = count(s, "n", "failed").join(own, "scenario", "left")
    listed, kind = (F.col("d") % 3 == 0) & F.col("own").isNotNull(), F.col("d") % 2 == 0
    return w.where(listed | kind).select("scenario", F.when(listed, F.col("own")).otherwise(F.col("n")).alias("total_ops"), F.when(listed, F.col("own_failed")).otherwise(F.col("failed")).alias("error_ops"))


def _roots(column: str, *names: str):
    def run(spark, sf):
        return PT.timeout_roots(spark, sf).select("node_id", "slot", "stuck", *(names or (column,)))

    return run


query("AGG27_root_cause", f"WITH {ARTIFACTS} SELECT node_id, slot, stuck, CASE WHEN l.durable >= stuck AND l.highest_committed < stuck THEN 'slot_owner_apply_or_reconcile' WHEN l.spool > 0 AND (l.credit = 0 OR l.blocked) THEN 'sender_spool_or_credit' WHEN l.upstream_in_flight AND l.upstream_confirmed < l.highest_committed THEN 'upstream_replay_or_confirm_debt' WHEN l.sent >= stuck AND l.acked < stuck AND l.durable < stuck THEN 'receiver_delivery_or_journal' ELSE 'unknown' END AS likely_stage FROM g")(_roots("likely_stage"))
query("TEL3_session_changes", f"WITH {ARTIFACTS} SELECT node_id, slot, stuck, f.credit <> l.credit AS credit_changed, (f.spool, f.sent, f.acked) IS DISTINCT FROM (l.spool, l.sent, l.acked) AS spool_changed FROM g")(_roots("", "credit_changed", "spool_changed"))
query("TEL4_apply_changes", f"WITH {ARTIFACTS} SELECT node_id, slot, stuck, f.highest_committed <> l.highest_committed OR f.applied <> l.applied AS apply_changed FROM g")(_roots("apply_changed"))


@query("AGG29_stuck_sequence", f"WITH {ARTIFACTS} SELECT artifact_id, stuck FROM a")
def stuck_sequence(spark, sf):
    return PT._artifacts(spark, sf).select("artifact_id", M.stuck_sequence().alias("stuck"))


@query("AGG30_journal_high_water", f"WITH {ARTIFACTS} SELECT artifact_id, durable FROM a")
def journal_high_water(spark, sf):
    return PT._artifacts(spark, sf).select("artifact_id", F.greatest(F.coalesce("journal_durable", F.lit(0)), "slot_durable").alias("durable"))


@query("SRT9_root_order", f"WITH {ARTIFACTS} SELECT node_id || '/' || slot || '/' || stuck AS place, row_number() OVER (ORDER BY node_id || '/' || slot || '/' || stuck) AS k FROM g")
def root_order(spark, sf):
    """Roots by the text of node, slot and sequence; one row a stuck write."""
    places = PT.timeout_roots(spark, sf).select("place")
    return places.withColumn("k", F.row_number().over(W.orderBy("place")).cast("bigint"))


@query("WIN5_network_rates", f"""WITH {PROBES}, d AS (SELECT c.node, c.seq, (epoch_us(c."at") - epoch_us(p."at")) / 1e6 AS seconds, c.i FROM probes c JOIN probes p ON p.node = c.node AND p.i = c.i - 1),
    moved AS (SELECT c.node, c.i, sum(greatest(c.rx - coalesce(p.rx, 0), 0)) AS rx, sum(greatest(c.tx - coalesce(p.tx, 0), 0)) AS tx FROM net c LEFT JOIN net p ON p.node = c.node AND p.i = c.i - 1 AND p.name = c.name GROUP BY c.node, c.i)
    SELECT 'node-' || d.node AS node_id, d.seq, round(rx / seconds / 1024 / 1024, 4) AS rx_mb_s, round(tx / seconds / 1024 / 1024, 4) AS tx_mb_s FROM d JOIN moved m ON m.node = d.node AND m.i = d.i WHERE seconds > 0""")
def network_rates(spark, sf):
    return PT.host_rates(spark, sf).select("node_id", "seq", "rx_mb_s", "tx_mb_s")


@query("TEL2_guarded_durations", f"""WITH {TRACE}, e AS (SELECT slot, sequence, min("at") FILTER (stage = 's1') AS a, min("at") FILTER (stage = 's2') AS b FROM trace GROUP BY slot, sequence) SELECT count(*) AS samples FROM e WHERE b >= a""")
def guarded_durations(spark, sf):
    """A duration counts if both ends are there and the second is not before the first."""
    e = M.earliest(PT._trace(spark, sf), ["slot", "sequence"], ["s1", "s2"])
    return e.where("s2 >= s1").agg(F.count("*").alias("samples"))


@query("AGG42_labelled_counters", f"WITH {COUNTERS} SELECT stage, role, result, count(*) AS count FROM counters GROUP BY ALL")
def labelled_counters(spark, sf):
    return S.counters(spark, sf).groupBy("stage", "role", "result").agg(F.count("*").alias("count"))


@query("AGG43_size_buckets", "WITH b AS (SELECT unnest([32, 64, 128, 256, 512]) AS upper) SELECT e.event_type, b.upper, count(*) AS n FROM events e JOIN b ON strlen(props) * 40 <= upper GROUP BY ALL")
def size_buckets(spark, sf):
    """Cumulative counts of sizes by fixed bounds: one aggregate, whatever their number."""
    size = F.octet_length("props") * 40
    bounds = [32, 64, 128, 256, 512]
    n = S.table(spark, sf, "events").groupBy("event_type").agg(*[F.count_if(size <= b).alias(f"b{b}") for b in bounds])
    return n.select("event_type", F.explode(F.array(*[F.struct(F.lit(b).alias("upper"), F.col(f"b{b}").alias("n")) for b in bounds])).alias("x")).select("event_type", "x.*").where("n > 0")


@query("AGG40_slot_usage", f"{LOG} SELECT slot, count(*) AS operations, sum(strlen(value)) AS bytes, count(DISTINCT key) AS keys FROM log GROUP BY slot")
def slot_usage(spark, sf):
    return _log(spark, sf).groupBy("slot").agg(F.count("*").alias("operations"), F.sum(F.octet_length("value")).alias("bytes"), F.count_distinct("key").alias("keys"))


@query("AGG41_heartbeat_summary", f"WITH {REPLICAS} SELECT node_id, count(*) AS replica_count, count(*) FILTER (state = 'active') AS active_count, count(*) FILTER (state = 'joining') AS catching_up_count, count(*) FILTER (state = 'leaving') AS leaving_count FROM replicas GROUP BY node_id")
def heartbeat_summary(spark, sf):
    n = lambda s, name: F.count_if(F.col("state") == s).alias(name)
    return S.replicas(spark, sf).groupBy("node_id").agg(F.count("*").alias("replica_count"), n("active", "active_count"), n("joining", "catching_up_count"), n("leaving", "leaving_count"))


@query("AGG33_coordinator_counts", f"WITH {ROUTES}, r AS (SELECT count(*) AS routes, count(*) FILTER (writable) AS writable FROM routes), c AS (SELECT count(*) FILTER (state = 'active') AS active, count(*) FILTER (state = 'joining') AS joining, count(*) FILTER (state = 'leaving') AS leaving FROM replicas) SELECT * FROM r, c")
def coordinator_counts(spark, sf):
    r = PC._routes(spark, sf).select(F.lit("routes").alias("k"), F.col("writable").alias("w"), F.lit(None).cast("string").alias("state"))
    c = S.replicas(spark, sf).select(F.lit("replica").alias("k"), F.lit(None).cast("boolean").alias("w"), "state")
    n = lambda cond, name: F.count_if(F.expr(cond)).alias(name)
    return r.unionByName(c).agg(n("k = 'routes'", "routes"), n("w", "writable"), n("state = 'active'", "active"), n("state = 'joining'", "joining"), n("state = 'leaving'", "leaving"))


@query("WIN11_bounded_traces", f"""WITH {TRACE}, f AS (SELECT slot, sequence, min("at") AS "at" FROM trace WHERE stage = 's2' GROUP BY slot, sequence) SELECT slot, sequence, "at" FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY sequence DESC) AS r FROM f) WHERE r <= 256""")
def bounded_traces(spark, sf):
    """The last 256 failures of a slot."""
    failed = PT._trace(spark, sf).where("stage = 's2'").groupBy("slot", "sequence").agg(F.min("at").alias("at"))
    return L.last_n(failed, ["slot"], "sequence", 256).select("slot", "sequence", "at")


@query("KVO10_confirmed_cursor", f"{LOG}, c AS (SELECT slot, max(sequence) AS top FROM log GROUP BY slot) SELECT slot, CASE WHEN slot % 3 = 0 THEN top ELSE top // 2 END AS confirmed FROM c")
def confirmed_cursor(spark, sf):
    """A head or single replica has nobody upstream: what it has committed is confirmed."""
    c = _log(spark, sf).groupBy("slot").agg(F.max("sequence").alias("top"))
    return c.select("slot", F.when(F.col("slot") % 3 == 0, F.col("top")).otherwise(F.floor(F.col("top") / 2)).alias("confirmed"))


@query("TEL11_coordinator_state", "SELECT o_custkey % 7 AS node, o_orderstatus AS kind, count(*) FILTER (o_orderkey % 4 <> 0) AS outbox, count(*) FILTER (o_orderkey % 4 = 0) AS pending FROM orders GROUP BY ALL")
def coordinator_state(spark, sf):
    sent = F.col("o_orderkey") % 4 != 0
    return S.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 7).alias("node"), F.col("o_orderstatus").alias("kind")).agg(F.count_if(sent).alias("outbox"), F.count_if(~sent).alias("pending"))


@query("API14_staged_sequences", f"{LOG}, c AS (SELECT slot, CAST(floor(max(sequence) * 0.9) AS BIGINT) AS prepared FROM log GROUP BY slot) SELECT slot, count(*) FILTER (sequence <= prepared) AS staged, count(*) FILTER (sequence > prepared) AS buffered, min(sequence) FILTER (sequence > prepared) AS first_buffered FROM log JOIN c USING (slot) GROUP BY slot")
def staged_sequences(spark, sf):
    log = _log(spark, sf)
    cut = log.groupBy("slot").agg(F.floor(F.max("sequence") * 0.9).alias("prepared"))
    late = F.col("sequence") > F.col("prepared")
    return log.join(cut, "slot").groupBy("slot").agg(F.count_if(~late).alias("staged"), F.count_if(late).alias("buffered"), F.min(F.when(late, F.col("sequence"))).alias("first_buffered"))


@query("API15_node_state", f"WITH {REPLICAS} SELECT node_id, string_agg(slot, ',' ORDER BY slot) FILTER (state = 'joining') AS catching_up, count(*) FILTER (state = 'leaving') AS leaving FROM replicas GROUP BY node_id")
def node_state(spark, sf):
    """Slots that a node catches up on, in order; it is one answer of one node."""
    mine = F.collect_list(F.when(F.col("state") == "joining", F.col("slot")))
    listed = F.array_join(F.transform(F.sort_array(mine), lambda s: s.cast("string")), ",")
    return S.replicas(spark, sf).groupBy("node_id").agg(F.when(F.size(mine) > 0, listed).alias("catching_up"), F.count_if(F.col("state") == "leaving").alias("leaving"))


@query("SRC5_local_replicas", f"WITH {REPLICAS} SELECT slot, state, node_id FROM replicas WHERE starts_with(node_id, 'Supplier#00000000')")
def local_replicas(spark, sf):
    """Replica metadata by node prefix: a range of a sorted key, which reaches the scan as a filter."""
    return S.replicas(spark, sf).where(F.col("node_id").startswith("Supplier#00000000")).select("slot", "state", "node_id")


@query("SRC7_latest_checkpoint", "SELECT o_custkey AS shard, max(o_orderkey) AS index, arg_max(o_orderstatus, o_orderkey) AS payload FROM orders GROUP BY o_custkey")
def latest_checkpoint(spark, sf):
    return S.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("shard")).agg(F.max("o_orderkey").alias("index"), F.max_by("o_orderstatus", "o_orderkey").alias("payload"))


_FNV = """list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(list_concat(list_concat(
    list_transform(range(0, 8), lambda i: (slot >> (8 * i)) & 255), list_transform(range(0, 8), lambda i: (sequence >> (8 * i)) & 255)), [1, 0, 0, 0, 0, 0, 0, 0]), lambda b: CAST(b AS HUGEINT))),
    lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"""


@query("FLT8_trace_sample", f"WITH {TRACE}, d AS (SELECT DISTINCT slot, sequence FROM trace) SELECT slot, sequence FROM d WHERE {_FNV} % 8 = 0")
def sampled_writes(spark, sf):
    t = PT._trace(spark, sf).select("slot", "sequence").distinct()
    return t.where(sampled(F.col("slot"), F.col("sequence"), F.lit(1), 8))


@query("GEN2_key_pools", f"{OPS}, k AS (SELECT DISTINCT slot, key, length(key) AS n FROM ops) SELECT slot, key FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY n, key) AS r FROM k) WHERE r <= 4")
def slot_key_pools(spark, sf):
    """The first four keys of each slot among all keys of the table, shorter ones first."""
    keys = S.operations(spark, sf).select("slot", "key").distinct()
    first = F.row_number().over(W.partitionBy("slot").orderBy(F.length("key"), "key"))
    return keys.withColumn("r", first).where("r <= 4").select("slot", "key")


@query("PLN14_normalized_nodes", "SELECT s_suppkey AS n, CASE WHEN s_suppkey % 6 = 0 THEN 'empty_id' WHEN s_suppkey % 7 = 0 THEN 'no_domains' WHEN count(*) OVER (PARTITION BY s_suppkey % 40) > 1 AND s_suppkey > 40 THEN 'repeated' END AS problem FROM supplier")
def normalized_nodes(spark, sf):
    """Why a node is refused: no id, no failure domains, or an id that an earlier one has."""
    k = F.col("s_suppkey")
    n = F.count("*").over(W.partitionBy(k % 40))
    return S.table(spark, sf, "supplier").select(k.alias("n"), F.when(k % 6 == 0, "empty_id").when(k % 7 == 0, "no_domains").when((n > 1) & (k > 40), "repeated").alias("problem"))


@query("PLN13_event_application", f"WITH {BEATS}, e AS (SELECT node_id, seq, CASE seq % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'drain' WHEN 2 THEN 'register' ELSE 'dead' END AS kind FROM beats WHERE seq % 3 <> 1) SELECT node_id, bool_or(kind = 'dead') AS dead, bool_or(kind = 'drain') AND NOT bool_or(kind = 'dead') AS draining, bool_or(kind IN ('add', 'register')) AND NOT bool_or(kind = 'dead') AS member FROM e GROUP BY node_id")
def event_application(spark, sf):
    """Membership after all events: a dead node stays dead, whatever is told of it later."""
    kind = F.when(F.col("seq") % 4 == 0, "add").when(F.col("seq") % 4 == 1, "drain").when(F.col("seq") % 4 == 2, "register").otherwise("dead")
    e = S.heartbeats(spark, sf).where("seq % 3 <> 1").withColumn("kind", kind)
    dead = F.bool_or(F.col("kind") == "dead")
    return e.groupBy("node_id").agg(dead.alias("dead"), (F.bool_or(F.col("kind") == "drain") & ~dead).alias("draining"), (F.bool_or(F.col("kind").isin("add", "register")) & ~dead).alias("member"))


@query("PLN19_startup_budget", f"WITH {REPLICAS}, s AS (SELECT slot, count(*) = {FACTOR} AND bool_and(state = 'active') AS settled FROM replicas GROUP BY slot) SELECT count(*) AS slots, CASE WHEN bool_and(settled) THEN 8 ELSE greatest(8, least(count(*), 1024)) END AS budget FROM s")
def startup_budget(spark, sf):
    """Until all chains are settled, as many changes as slots are allowed, 1024 at most."""
    s = C.chains(S.replicas(spark, sf)).select(C.settled("chain", FACTOR).alias("settled"))
    return s.agg(F.count("*").alias("slots"), F.when(F.bool_and("settled"), F.lit(8)).otherwise(F.greatest(F.lit(8), F.least(F.count("*"), F.lit(1024)))).cast("bigint").alias("budget"))
