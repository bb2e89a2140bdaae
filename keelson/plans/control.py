"""Queries of the control plane: chains, routes, placement, recovery, liveness, commands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators import control as C
from keelson.operators.log import last_n
from keelson.plans.names import query
from keelson.sources import tables as S

FACTOR = 3
NODES = """nodes AS (SELECT s_suppkey AS n, s_name AS node_id, n_name AS nation, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
REPLICAS = f"""{NODES}, li AS (SELECT l_partkey AS slot, l_suppkey AS n, min(l_linenumber) AS line FROM lineitem GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY line, n) - 1 AS pos FROM li),
replicas AS (SELECT slot, pos, p.n, node_id, CASE line WHEN 7 THEN 'leaving' WHEN 6 THEN 'joining' ELSE 'active' END AS state FROM placed p JOIN nodes USING (n) WHERE pos <= {FACTOR})"""
ASSIGNED = f"""{REPLICAS}, assigned AS (SELECT slot, pos, n, node_id, state, CASE WHEN count(*) OVER s = 1 THEN 'single' WHEN row_number() OVER w = 1 THEN 'head' WHEN row_number() OVER w = count(*) OVER s THEN 'tail' ELSE 'middle' END AS role,
    lag(node_id) OVER w AS predecessor, lead(node_id) OVER w AS successor, arg_max(node_id, pos) FILTER (state = 'active') OVER s AS tail FROM replicas WINDOW s AS (PARTITION BY slot), w AS (PARTITION BY slot ORDER BY pos))"""


@query("PRJ3_assignments", f"WITH {ASSIGNED} SELECT slot, pos, node_id, state, role, predecessor, successor, tail FROM assigned")
def assignments(spark, sf):
    return C.assignments(S.replicas(spark, sf))


# replicas of every 11th node are unavailable in every 3rd slot; every 17th slot's peers are being refreshed
BLANK = "blank AS (SELECT slot FROM replicas WHERE state = 'active' AND n % 11 = 3 AND slot % 3 = 0 UNION SELECT slot FROM replicas WHERE slot % 17 = 0)"
ROUTES = f"""{REPLICAS}, {BLANK}, routes AS (SELECT slot, first(node_id ORDER BY pos) FILTER (state = 'active' AND NOT b) AS head, last(node_id ORDER BY pos) FILTER (state = 'active' AND NOT b) AS tail,
    count(*) FILTER (state = 'active' AND NOT b) AS serving, serving > 0 AS readable, serving > 0 AND count(*) FILTER (state = 'joining') = 0 AS writable FROM (SELECT r.*, slot IN (SELECT slot FROM blank) AS b FROM replicas r) GROUP BY slot)"""


def _routes(spark, sf) -> DataFrame:
    r = S.replicas(spark, sf)
    gone = r.where("n % 11 = 3 and slot % 3 = 0").select("node_id", "slot")
    return C.routes(r, gone, r.where("slot % 17 = 0").select("slot").distinct())


@query("PLN16_routing_view", f"WITH {ROUTES} SELECT * FROM routes")
def routing_view(spark, sf):
    return _routes(spark, sf).select("slot", "head", "tail", F.size("read_replicas").cast("bigint").alias("serving"), "readable", "writable")


@query("JON11_blanked_slots", f"WITH {REPLICAS} SELECT DISTINCT slot FROM replicas WHERE state = 'active' AND n % 11 = 3 AND slot % 3 = 0")
def blanked(spark, sf):
    r = S.replicas(spark, sf)
    gone = r.where("n % 11 = 3 and slot % 3 = 0").select("node_id", "slot")
    return r.where("state = 'active'").join(gone, ["node_id", "slot"], "left_semi").select("slot").distinct()


@query("JON1_key_routes", f"WITH {ROUTES} SELECT o_orderkey, l.slot, head, coalesce(readable, false) AS readable FROM (SELECT o_orderkey, o_custkey AS slot FROM orders) l LEFT JOIN routes USING (slot)")
def key_routes(spark, sf):
    keys = S.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("slot"))
    return C.routed(keys, _routes(spark, sf)).select("o_orderkey", "slot", "head", F.coalesce("readable", F.lit(False)).alias("readable"))


@query("FLT4_write_check", f"WITH {ASSIGNED} SELECT o_orderkey, CASE WHEN a.slot IS NULL THEN 'unknown_slot' WHEN state <> 'active' THEN 'inactive' WHEN o_orderkey % 5 = 0 THEN 'wrong_version' WHEN role NOT IN ('head', 'single') THEN 'wrong_role' END AS refused, CASE WHEN a.slot IS NULL THEN 'unknown_slot' WHEN state <> 'active' THEN 'inactive' WHEN o_orderkey % 5 = 0 THEN 'wrong_version' END AS read_refused FROM orders LEFT JOIN assigned a ON a.slot = o_custkey * 2 AND a.pos = o_orderkey % 3")
def write_check(spark, sf):
    asked = S.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("slot"), (F.col("o_orderkey") % 3).alias("pos"))
    j = asked.join(C.assignments(S.replicas(spark, sf)), ["slot", "pos"], "left")
    checks = F.col("role").isNotNull(), F.col("state") == "active", F.col("o_orderkey") % 5 != 0
    return j.select("o_orderkey", C.write_check(*checks, F.col("role")).alias("refused"), C.read_check(*checks).alias("read_refused"))


@query("KVO7_read_targets", f"WITH {ROUTES} SELECT slot, greatest(serving, 1) AS targets FROM routes")
def read_targets(spark, sf):
    return _routes(spark, sf).select("slot", F.size(C.read_targets(F.col("read_replicas"), F.col("tail"))).cast("bigint").alias("targets"))


@query("FLT9_settled", f"WITH {REPLICAS} SELECT slot, count(*) = {FACTOR} AND bool_and(state = 'active') AS settled FROM replicas GROUP BY slot")
def settled(spark, sf):
    return C.chains(S.replicas(spark, sf)).select("slot", C.settled("chain", FACTOR).alias("settled"))


@query("FLT7_eligible", f"""WITH {REPLICAS}, short AS (SELECT slot FROM replicas GROUP BY slot HAVING count(*) FILTER (state = 'active') < {FACTOR}), mine AS (SELECT slot, node_id, nation, region FROM replicas JOIN nodes USING (node_id) WHERE slot IN (SELECT slot FROM short))
    SELECT s.slot, n.node_id FROM short s, nodes n WHERE NOT EXISTS (SELECT 1 FROM mine m WHERE m.slot = s.slot AND (m.node_id = n.node_id OR m.nation = n.nation OR m.region = n.region))""")
def eligible(spark, sf):
    r = S.replicas(spark, sf)
    short = r.groupBy("slot").agg(F.count_if(F.col("state") == "active").alias("a")).where(F.col("a") < FACTOR).select("slot")
    return C.eligible(S.nodes(spark, sf), r.join(short, "slot", "left_semi"))


@query("AGG35_assignment_counts", f"WITH {REPLICAS}, e AS (SELECT *, min(pos) OVER s AS a, max(pos) OVER s AS z FROM replicas WINDOW s AS (PARTITION BY slot)) SELECT node_id, count(*) FILTER (pos = a) AS heads, count(*) FILTER (pos = z) AS tails, count(*) AS replicas FROM e GROUP BY node_id")
def assignment_counts(spark, sf):
    return C.load(S.replicas(spark, sf))


@query("SRT1_best_candidate", f"""WITH {REPLICAS}, e AS (SELECT *, min(pos) OVER s AS a, max(pos) OVER s AS z FROM replicas WINDOW s AS (PARTITION BY slot)), l AS (SELECT node_id, count(*) FILTER (pos = a) AS heads, count(*) FILTER (pos = z) AS tails, count(*) AS replicas FROM e GROUP BY node_id)
    SELECT slot, node_id FROM (SELECT r.slot, l.node_id, row_number() OVER (PARTITION BY r.slot ORDER BY tails, heads, replicas, l.node_id) AS k FROM replicas r JOIN l USING (node_id)) WHERE k = 1""")
def best_candidate(spark, sf):
    r = S.replicas(spark, sf)
    return C.best_candidates(r.select("slot", "node_id"), C.load(r))


@query("SRT3_append_priority", f"WITH {REPLICAS} SELECT slot, replicas FROM (SELECT slot, count(*) AS replicas, row_number() OVER (ORDER BY count(*), slot) AS k FROM replicas GROUP BY slot) WHERE k <= 12")
def append_priority(spark, sf):
    """The first twelve slots to append to: the change budget is the feature."""
    return C.budgeted(S.replicas(spark, sf).groupBy("slot").agg(F.count("*").alias("replicas")), 12, True)


@query("SRT12_rotation", f"WITH {NODES}, r AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS rank, count(*) OVER () AS n FROM nodes WHERE n <= {FACTOR}) SELECT slot, ((rank - slot) % n + n) % n AS pos, node_id FROM (SELECT p_partkey AS slot FROM part), r")
def rotation(spark, sf):
    return C.rotation(S.table(spark, sf, "part").select(F.col("p_partkey").alias("slot")), S.nodes(spark, sf).where(F.col("n") <= FACTOR))


@query("PLN21_violations", f"WITH {REPLICAS} SELECT slot, CASE WHEN count(DISTINCT node_id) < count(*) THEN 'duplicate_node' WHEN count(*) FILTER (state = 'active') = 0 THEN 'no_active' ELSE 'too_long' END AS problem FROM replicas GROUP BY slot HAVING count(DISTINCT node_id) < count(*) OR count(*) FILTER (state = 'active') = 0 OR count(*) > 3")
def violations(spark, sf):
    return C.violations(S.replicas(spark, sf), 2)


@query("SET9_change_shape", f"""WITH {REPLICAS}, c AS (SELECT slot, list(node_id ORDER BY pos) AS now, list(node_id ORDER BY pos) FILTER (state <> 'leaving') AS kept FROM replicas GROUP BY slot), w AS (SELECT slot, now, CASE slot % 5 WHEN 0 THEN now WHEN 1 THEN list_append(now, 'new') WHEN 2 THEN list_append(now[:-2], 'new') WHEN 3 THEN ['new'] ELSE list_reverse(now) END AS wanted FROM c)
    SELECT slot, CASE WHEN now = wanted THEN 'same' WHEN slot % 5 = 1 THEN 'prefix' WHEN slot % 5 = 2 THEN 'replace' WHEN slot % 5 = 3 AND len(now) = 1 THEN 'replace' WHEN slot % 5 = 3 THEN 'disjoint' ELSE 'other' END AS shape FROM w""")
def change_shape(spark, sf):
    now = C.members("chain")
    c = C.chains(S.replicas(spark, sf)).select("slot", now.alias("now"))
    new = F.array(F.lit("new"))
    k = F.col("slot") % 5
    wanted = F.when(k == 0, F.col("now")).when(k == 1, F.concat("now", new)).when(k == 2, F.concat(F.slice("now", F.lit(1), F.size("now") - 1), new)).when(k == 3, new).otherwise(F.reverse("now"))
    return c.withColumn("wanted", wanted).select("slot", C.change_shape(F.col("now"), F.col("wanted")).alias("shape"))


@query("JON6_recovery_triage", f"""WITH {ASSIGNED}, rep AS (SELECT node_id, slot + (n % 3 = 0)::INT * 100000 AS slot, slot % 4 <> 0 AS has_data, CASE WHEN slot % 5 = 0 THEN 'syncing' ELSE 'active' END AS last_state, CASE WHEN slot % 7 <> 0 THEN node_id ELSE '' END AS tail FROM replicas)
    SELECT r.node_id, r.slot, CASE WHEN a.slot IS NULL THEN 'drop' WHEN a.role IN ('tail', 'single') AND has_data AND last_state = 'active' AND (r.tail = '' OR coalesce(r.tail = a.tail, false)) THEN 'resume' ELSE 'recover' END AS action, CASE WHEN action = 'recover' THEN coalesce(predecessor, successor) END AS source FROM rep r LEFT JOIN assigned a USING (node_id, slot)""")
def recovery(spark, sf):
    r = S.replicas(spark, sf)
    moved = F.when(F.col("n") % 3 == 0, F.col("slot") + 100_000).otherwise(F.col("slot")).alias("slot")
    reported = r.select("node_id", moved, (F.col("slot") % 4 != 0).alias("has_data"), F.when(F.col("slot") % 5 == 0, "syncing").otherwise("active").alias("last_state"), F.when(F.col("slot") % 7 != 0, F.col("node_id")).otherwise("").alias("tail"))
    return C.recovery(reported, C.assignments(r))


@query("JON10_unassigned_nodes", f"WITH {REPLICAS} SELECT node_id FROM nodes WHERE n % 7 <> 0 AND n % 4 <> 1 AND node_id NOT IN (SELECT node_id FROM replicas WHERE pos = 0 AND slot % 2 = 0)")
def unassigned(spark, sf):
    used = S.replicas(spark, sf).where("pos = 0 and slot % 2 = 0").select("node_id").distinct()
    return S.nodes(spark, sf).where("n % 7 <> 0 and n % 4 <> 1").join(used, "node_id", "left_anti").select("node_id")


@query("FLT14_identity_conflict", f"WITH {NODES} SELECT node_id, n % 5 = 0 OR n % 4 = 0 AS conflict FROM nodes")
def identity(spark, sf):
    again = F.when(F.col("n") % 4 == 0, F.create_map(F.lit("nation"), F.lit("elsewhere"))).otherwise(F.create_map(F.lit("rack"), F.lit("r1")))
    address = F.when(F.col("n") % 5 == 0, F.lit("10.9.9.9")).otherwise(F.col("rpc_address"))
    return S.nodes(spark, sf).select("node_id", C.identity_conflict(F.col("domains"), again, F.col("rpc_address"), address).alias("conflict"))


@query("AGG44_unavailable_slots", f"WITH {REPLICAS} SELECT node_id, count(DISTINCT slot) AS slots, min(slot) AS first, max(slot) AS last FROM replicas WHERE state <> 'active' GROUP BY node_id")
def unavailable(spark, sf):
    gone = S.replicas(spark, sf).where("state <> 'active'").groupBy("node_id")
    return gone.agg(F.count_distinct("slot").alias("slots"), F.min("slot").alias("first"), F.max("slot").alias("last"))


@query("AGG34_replica_states", f"WITH {REPLICAS} SELECT node_id, count(*) FILTER (state = 'active') AS active, count(*) FILTER (state = 'joining') AS joining, count(*) FILTER (state = 'leaving') AS leaving FROM replicas GROUP BY node_id")
def replica_states(spark, sf):
    return S.replicas(spark, sf).groupBy("node_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("active", "joining", "leaving")])


@query("AGG32_routing_counts", f"WITH {ROUTES} SELECT count(*) AS slots, count(*) FILTER (readable) AS readable, count(*) FILTER (writable) AS writable FROM routes")
def routing_counts(spark, sf):
    return _routes(spark, sf).agg(F.count("*").alias("slots"), F.count_if("readable").alias("readable"), F.count_if("writable").alias("writable"))


# --- commands and outboxes: orders are commands of their customers' slots

@query("JON13_outbox", "SELECT o_orderkey AS id, o_custkey AS slot, o_orderstatus AS kind FROM orders WHERE o_orderkey % 4 <> 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 6 = 0) UNION ALL SELECT c_custkey + 1000000000, c_custkey, 'plan' FROM customer WHERE c_custkey % 6 = 0")
def outbox(spark, sf):
    o, c = S.table(spark, sf, "orders"), S.table(spark, sf, "customer").where("c_custkey % 6 = 0")
    entries = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("slot"), F.col("o_orderstatus").alias("kind"))
    planned = c.select((F.col("c_custkey") + 1_000_000_000).alias("id"), F.col("c_custkey").alias("slot"), F.lit("plan").alias("kind"))
    return C.outbox_after(entries, entries.where("id % 4 = 0").select("id"), c.select(F.col("c_custkey").alias("slot")), planned)


@query("JON15_report_outcome", "SELECT o_orderkey AS report_id, CASE WHEN c_custkey IS NULL THEN 'no_pending' WHEN o_orderkey % 4 = 0 THEN 'wrong_kind' WHEN o_orderkey % 5 = 0 THEN 'wrong_node' WHEN o_orderkey % 7 = 0 THEN 'wrong_command' WHEN o_orderkey % 3 = 0 THEN 'wrong_version' ELSE 'accepted' END AS outcome FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) c ON c_custkey = o_custkey")
def report_outcome(spark, sf):
    k = F.col("o_orderkey")
    pick = lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good)
    reports = S.table(spark, sf, "orders").select(k.alias("report_id"), F.col("o_custkey").alias("slot"), pick(4, "removed", "ready").alias("kind"), pick(5, "b", "a").alias("node_id"), pick(7, "c2", "c1").alias("command_id"), pick(3, 2, 1).alias("version"))
    pending = S.table(spark, sf, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("slot"), F.lit("ready").alias("kind"), F.lit("a").alias("node_id"), F.lit("c1").alias("command_id"), F.lit(1).alias("version"))
    return C.report_outcome(reports, pending)


@query("JON17_duplicate_commands", "SELECT o_orderkey AS index, CASE WHEN row_number() OVER w = 1 THEN 'new' WHEN o_orderpriority = first_value(o_orderpriority) OVER w THEN 'duplicate' ELSE 'conflict' END AS outcome FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def duplicate_commands(spark, sf):
    return C.command_outcome(S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("index"), F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("payload")))


@query("STM10_slot_versions", "SELECT o_custkey AS slot, count(*) AS version FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey")
def slot_versions(spark, sf):
    kind = F.when(F.col("o_orderstatus") == "P", "progress").otherwise("reconfigure")
    return C.slot_versions(S.table(spark, sf, "orders").select(F.col("o_custkey").alias("slot"), kind.alias("kind")))


@query("WIN9_last_progress", "SELECT slot, id FROM (SELECT o_custkey AS slot, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 8")
def last_progress(spark, sf):
    return last_n(S.table(spark, sf, "orders").select(F.col("o_custkey").alias("slot"), F.col("o_orderkey").alias("id")), ["slot"], "id", 8)


@query("STM12_leases", "SELECT seq, lease, CAST(sum(CASE WHEN p IS NULL OR p <> holder THEN 1 ELSE 0 END) OVER (PARTITION BY lease ORDER BY seq) AS BIGINT) AS epoch FROM (SELECT o_orderkey AS seq, o_custkey AS lease, o_orderkey % 3 AS holder, lag(o_orderkey % 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)")
def leases(spark, sf):
    return C.leases(S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("lease"), (F.col("o_orderkey") % 3).alias("holder"))).select("seq", "lease", "epoch")


@query("FLT15_epoch_fence", "SELECT seq, CASE WHEN epoch = 0 THEN 'ignored' WHEN epoch < top THEN 'rejected' WHEN epoch = top THEN 'ignored' ELSE 'stored' END AS fence FROM (SELECT event_id AS seq, event_id % 13 AS epoch, coalesce(max(event_id % 13) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM events)")
def epoch_fence(spark, sf):
    return C.epoch_fence(S.table(spark, sf, "events").selectExpr("user_id AS node_id", "event_id AS seq", "event_id % 13 AS epoch")).select("seq", "fence")


# --- liveness

BEATS = """beats AS (SELECT 'node-' || user_id AS node_id, event_id AS seq, ts AS "at", CASE WHEN event_type = 'error' THEN 'suspect' WHEN event_type = 'signup' AND value > 40 THEN 'dead' ELSE 'healthy' END AS state FROM events)"""


@query("STM3_liveness_target", f"""WITH {BEATS}, l AS (SELECT node_id, max("at") AS last FROM beats GROUP BY node_id) SELECT node_id, CASE WHEN epoch_us(TIMESTAMP '2024-01-29') <= epoch_us(last) THEN 'healthy' WHEN epoch_us(TIMESTAMP '2024-01-29') - epoch_us(last) >= 172800000000 THEN 'dead' WHEN epoch_us(TIMESTAMP '2024-01-29') - epoch_us(last) >= 43200000000 THEN 'suspect' ELSE 'healthy' END AS target FROM l""")
def liveness_target(spark, sf):
    last = S.heartbeats(spark, sf).groupBy("node_id").agg(F.max("at").alias("last"))
    age = (F.unix_micros(F.lit("2024-01-29").cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 1e6
    return last.select("node_id", C.target_state(age, 43_200, 172_800).alias("target"))


@query("WIN15_flaps", f"""WITH {BEATS}, t AS (SELECT * FROM (SELECT *, lag(state) OVER (PARTITION BY node_id ORDER BY seq) AS b FROM beats) WHERE state = 'suspect' AND coalesce(b, '') <> 'suspect') SELECT node_id, seq, "at", count(*) OVER w AS flaps, count(*) OVER w >= 3 AS flapping FROM t WINDOW w AS (PARTITION BY node_id ORDER BY epoch_us("at") RANGE BETWEEN 259200000000 PRECEDING AND CURRENT ROW)""")
def flaps(spark, sf):
    return C.flaps(S.heartbeats(spark, sf), 259_200)


@query("JON18_merged_liveness", f"""WITH {BEATS}, d AS (SELECT node_id, arg_max(state, seq) AS state, max(seq) AS updated FROM beats WHERE seq % 3 = 0 GROUP BY node_id), f AS (SELECT node_id, arg_max(state, seq) AS state, max(seq) AS updated FROM beats WHERE seq % 3 = 1 GROUP BY node_id)
    SELECT node_id, CASE WHEN f.updated IS NULL OR (d.state IS NOT NULL AND (d.state = 'dead' OR d.updated >= f.updated)) THEN d.state ELSE f.state END AS state, CASE WHEN f.updated IS NULL OR (d.state IS NOT NULL AND (d.state = 'dead' OR d.updated >= f.updated)) THEN d.updated ELSE f.updated END AS updated FROM d FULL JOIN f USING (node_id)""")
def merged_liveness(spark, sf):
    newest = lambda k: S.heartbeats(spark, sf).where(F.col("seq") % 3 == k).groupBy("node_id").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("updated"))
    return C.merged_liveness(newest(0), newest(1))


@query("STM5_node_fold", f"WITH {BEATS} SELECT node_id, count(*) AS beats, max(seq) AS last_seen, bool_or(state = 'dead') AS dead, bool_or(state <> 'dead') AND NOT bool_or(state = 'dead') AS ready FROM beats GROUP BY node_id")
def node_fold(spark, sf):
    return C.node_fold(S.heartbeats(spark, sf))


@query("PLN20_lifecycle", f"""WITH {REPLICAS}, s AS (SELECT slot, pos, CASE slot % 3 WHEN 0 THEN 'activate' WHEN 1 THEN 'leave' ELSE 'remove' END AS step, state FROM replicas) SELECT slot, pos, CASE WHEN step = 'activate' AND state = 'active' THEN 'active' WHEN step = 'leave' AND state IN ('active', 'leaving') THEN 'leaving' WHEN step = 'remove' AND state = 'leaving' THEN 'removed' END AS next FROM s""")
def lifecycle(spark, sf):
    k = F.col("slot") % 3
    return C.lifecycle(S.replicas(spark, sf).select("slot", "pos", F.when(k == 0, "activate").when(k == 1, "leave").otherwise("remove").alias("step"), "state")).select("slot", "pos", "next")
