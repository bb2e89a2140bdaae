"""Queries of sources, retargeting, snapshots and transitions of replicas, registrations and outboxes.

Orders are replicas' slots; their lines are messages, both told and held.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators import control as C
from keelson.operators import replica as R
from keelson.plans.control import ASSIGNED
from keelson.plans.names import query
from keelson.sources import tables as S

STORES = ["staged", "buffered", "recent", "expected", "pending"]
_STORE = "[" + ", ".join(f"'{s}'" for s in STORES) + "]"
RECORDS = f"""rec AS (SELECT o_orderkey AS slot, CASE WHEN o_custkey % 7 = 0 THEN '' ELSE 'n' || (o_custkey % 3) END AS predecessor,
    CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'n' || (o_custkey % 4) END AS successor, o_custkey % 2 + 1 AS chain_version, o_orderkey % 4 AS committed,
    o_orderkey % 3 AS confirmed, o_orderkey % 5 AS token, o_orderkey % 6 AS prepared FROM orders),
held AS (SELECT l_orderkey AS slot, l_linenumber AS sequence, {_STORE}[CAST(l_suppkey % 5 AS INTEGER) + 1] AS store,
    CASE WHEN l_suppkey % 11 = 3 THEN '' ELSE 'n' || (l_suppkey % 3) END AS from_node, l_suppkey % 2 + 1 AS version FROM lineitem),
msg AS (SELECT l_orderkey AS slot, l_linenumber AS sequence, 'n' || (l_partkey % 3) AS from_node, l_partkey % 2 + 1 AS version FROM lineitem),
kept AS (SELECT slot, sequence, {", ".join(f"min({{'f': from_node, 'v': version}}) FILTER (store = '{s}') AS {s}" for s in STORES)} FROM held GROUP BY ALL)"""


def _name(of) -> F.Column:
    return F.concat(F.lit("n"), of.cast("string"))


def _records(spark, sf) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    peers = F.when(c % 7 == 0, "").otherwise(_name(c % 3)).alias("predecessor"), F.when(c % 5 == 0, "").otherwise(_name(c % 4)).alias("successor")
    cursors = (k % 4).alias("committed"), (k % 3).alias("confirmed"), (k % 5).alias("token"), (k % 6).alias("prepared")
    return S.table(spark, sf, "orders").select(k.alias("slot"), *peers, (c % 2 + 1).alias("chain_version"), *cursors)


def _held(spark, sf) -> DataFrame:
    s = F.col("l_suppkey")
    store = F.array(*[F.lit(x) for x in STORES])[(s % 5).cast("int")]
    return S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("slot"), F.col("l_linenumber").alias("sequence"), store.alias("store"), F.when(s % 11 == 3, "").otherwise(_name(s % 3)).alias("from_node"), (s % 2 + 1).alias("version"))


def _messages(spark, sf) -> DataFrame:
    p = F.col("l_partkey")
    return S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("slot"), F.col("l_linenumber").alias("sequence"), _name(p % 3).alias("from_node"), (p % 2 + 1).alias("version"))


_JUDGED = """SELECT slot, sequence, from_node, version, CASE WHEN node = '' OR node <> from_node THEN 'wrong_node' WHEN known <> version AND NOT also THEN 'wrong_version' ELSE 'accepted' END AS outcome FROM x"""


@query(
    "FLT17_forward_source",
    f"""WITH {RECORDS}, x AS (SELECT m.*, coalesce(k.staged.f, k.buffered.f, k.recent.f, predecessor) AS node, coalesce(k.staged.v, k.buffered.v, k.recent.v, chain_version) AS known,
    predecessor = from_node AND chain_version = version AS also FROM msg m JOIN rec USING (slot) LEFT JOIN kept k USING (slot, sequence)) {_JUDGED}""",
)
def forward_source(spark, sf):
    return R.forward_source(_messages(spark, sf), _held(spark, sf), _records(spark, sf))


@query(
    "FLT18_commit_source",
    f"""WITH {RECORDS}, e AS (SELECT m.*, rec.*, k.* EXCLUDE (slot, sequence, expected), CASE WHEN k.expected.f <> '' THEN k.expected END AS ex FROM msg m JOIN rec USING (slot) LEFT JOIN kept k USING (slot, sequence)),
    x AS (SELECT slot, sequence, from_node, version, coalesce(ex.f, buffered.f, recent.f, successor) AS node, coalesce(ex.v, buffered.v, recent.v, staged.v, chain_version) AS known,
    ex IS NOT NULL AND successor = from_node AND chain_version = version AS also FROM e) {_JUDGED}""",
)
def commit_source(spark, sf):
    return R.commit_source(_messages(spark, sf), _held(spark, sf), _records(spark, sf))


@query("FLT19_advance_source", f"WITH {RECORDS}, x AS (SELECT m.*, successor AS node, chain_version AS known, false AS also FROM msg m JOIN rec USING (slot)) {_JUDGED}")
def advance_source(spark, sf):
    return R.advance_source(_messages(spark, sf), _records(spark, sf))


@query(
    "LIF8_retargeted_forwards",
    f"""WITH {RECORDS} SELECT h.slot, sequence, store, from_node, CASE WHEN predecessor <> '' AND from_node = predecessor THEN chain_version ELSE version END AS version
    FROM held h JOIN rec USING (slot) WHERE store IN ('staged', 'buffered') AND sequence > committed""",
)
def retargeted_forwards(spark, sf):
    return R.retarget_forwards(_held(spark, sf), _records(spark, sf))


@query("LIF9_retargeted_commits", f"WITH {RECORDS} SELECT h.slot, sequence, successor AS from_node, chain_version AS version FROM held h JOIN rec USING (slot) WHERE store = 'expected' AND sequence > committed AND successor <> ''")
def retargeted_commits(spark, sf):
    return R.retarget_commits(_held(spark, sf), _records(spark, sf))


@query(
    "LIF4_updated_peers",
    f"""WITH {RECORDS}, w AS (SELECT *, CASE WHEN slot % 3 = 0 THEN predecessor ELSE 'n' || (slot % 3) END AS p, CASE WHEN slot % 4 = 0 THEN successor WHEN slot % 4 = 1 THEN '' ELSE 'n' || (slot % 4) END AS s, chain_version + slot % 2 AS v FROM rec)
    SELECT slot, CASE WHEN p <> predecessor THEN committed ELSE confirmed END AS confirmed, CASE WHEN (v <> chain_version OR s <> successor) AND s = '' THEN greatest(prepared, token) ELSE token END AS token,
    v <> chain_version OR p <> predecessor AS forwards, v <> chain_version OR s <> successor AS commits FROM w""",
)
def updated_peers(spark, sf):
    r, k = _records(spark, sf), F.col("slot")
    p = F.when(k % 3 == 0, F.col("predecessor")).otherwise(_name(k % 3))
    s = F.when(k % 4 == 0, F.col("successor")).when(k % 4 == 1, "").otherwise(_name(k % 4))
    return R.updated_peers(r, r.select("slot", p.alias("new_predecessor"), s.alias("new_successor"), (F.col("chain_version") + k % 2).alias("new_version")))


# --- snapshots: a slot's snapshot ends at a sequence that its customer's number gives

_LEFT = "l AS (SELECT h.slot, count(*) AS kept, count(*) FILTER (store <> 'buffered') AS dirty FROM held h JOIN sl USING (slot) WHERE store IN ('pending', 'staged', 'buffered') AND sequence > snapshot GROUP BY h.slot)"
_SLOTS = "sl AS (SELECT o_orderkey AS slot, o_custkey % 5 AS snapshot, o_orderkey % 4 AS committed, o_orderkey % 4 + 1 AS next_sequence FROM orders)"
_REBASED = "SELECT slot, snapshot AS committed, greatest(next_sequence, snapshot + 1) AS next_sequence, coalesce(kept, 0) AS kept, coalesce(dirty, 0) AS dirty FROM {slots} LEFT JOIN l USING (slot)"


def _slots(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    return S.table(spark, sf, "orders").select(k.alias("slot"), (F.col("o_custkey") % 5).alias("snapshot"), (k % 4).alias("committed"), (k % 4 + 1).alias("next_sequence"))


@query("STF17_rebased_state", f"WITH {RECORDS}, {_SLOTS}, {_LEFT} {_REBASED.format(slots='sl')}")
def rebased_state(spark, sf):
    return R.rebased(_slots(spark, sf), _held(spark, sf))


@query(
    "STF16_gap_catchup",
    f"""WITH {RECORDS}, {_SLOTS}, g AS (SELECT slot FROM held JOIN sl USING (slot) WHERE store = 'buffered' AND sequence >= next_sequence GROUP BY slot HAVING min(sequence) > min(next_sequence)),
    behind AS (SELECT * FROM sl WHERE snapshot > committed AND slot IN (SELECT slot FROM g)), {_LEFT} {_REBASED.format(slots='behind')}""",
)
def gap_catchup(spark, sf):
    return R.gap_catchup(_slots(spark, sf), _held(spark, sf))


# --- transitions: a slot's state by its number; every second asks for the assignment that it has

STATES = "st AS (SELECT o_orderkey AS slot, ['catching_up', 'active', 'leaving', 'recovered', NULL][CAST(o_orderkey % 5 AS INTEGER) + 1] AS state, o_custkey % 2 = 0 AS same, o_custkey % 9 AS snapshot FROM orders)"


def _steps(spark, sf, step: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    state = F.when(k == 0, "catching_up").when(k == 1, "active").when(k == 2, "leaving").when(k == 3, "recovered")
    return R.transition(S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("slot"), F.lit(step).alias("step"), state.alias("state"), (F.col("o_custkey") % 2 == 0).alias("same"), (F.col("o_custkey") % 9).alias("snapshot")))


@query("LIF1_activation", f"WITH {STATES} SELECT slot, CASE WHEN state IS NULL THEN 'unknown' WHEN state = 'active' THEN 'unchanged' WHEN state = 'catching_up' THEN 'active' ELSE 'invalid' END AS outcome FROM st")
def activation(spark, sf):
    return _steps(spark, sf, "activate").select("slot", "outcome")


@query(
    "LIF6_recovery",
    f"""WITH {STATES}, r AS (SELECT *, CASE WHEN state = 'active' AND same THEN 'unchanged' WHEN state IS NULL OR state = 'recovered' THEN 'active' ELSE 'invalid' END AS outcome FROM st)
    SELECT slot, outcome, CASE WHEN outcome = 'active' THEN snapshot END AS committed, CASE WHEN outcome = 'active' THEN snapshot + 1 END AS next_sequence FROM r""",
)
def recovery(spark, sf):
    """A recovered replica's cursors are all the snapshot's sequence."""
    at = F.when(F.col("outcome") == "active", F.col("snapshot"))
    return _steps(spark, sf, "recover").select("slot", "outcome", at.alias("committed"), (at + 1).alias("next_sequence"))


@query(
    "LIF7_dropped",
    f"""WITH {STATES}, {RECORDS}, d AS (SELECT slot, CASE WHEN state IS NULL THEN 'unknown' WHEN state = 'recovered' THEN 'removed' ELSE 'invalid' END AS outcome FROM st)
    SELECT outcome, count(DISTINCT d.slot) AS slots, count(h.slot) FILTER (outcome <> 'removed') AS entries FROM d LEFT JOIN held h USING (slot) GROUP BY outcome""",
)
def dropped(spark, sf):
    """Only recovered replicas can be dropped, and what they held goes with them."""
    d = _steps(spark, sf, "drop").select("slot", "outcome")
    left = _held(spark, sf).join(d.where("outcome = 'removed'"), "slot", "left_anti").groupBy("slot").agg(F.count("*").alias("n"))
    return d.join(left, "slot", "left").groupBy("outcome").agg(F.count("*").alias("slots"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries"))


# --- coordinator: registrations, mutations, heartbeats and outboxes

@query(
    "CRD1_registration",
    """WITH known AS (SELECT s_suppkey AS n, '10.0.0.' || s_suppkey AS address, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    asked AS (SELECT c_custkey, c_custkey % 25 + 1 AS n, CASE WHEN c_custkey % 4 = 0 THEN 'moved' ELSE '10.0.0.' || (c_custkey % 25 + 1) END AS address, n_name FROM customer JOIN nation ON n_nationkey = c_custkey % 25)
    SELECT c_custkey AS report_id, CASE WHEN coalesce(k.address = a.address AND (k.n_name = a.n_name OR c_custkey % 2 = 0) AND k.n % 6 <> 1, false) THEN 'unchanged' ELSE 'reconfigure' END AS outcome FROM asked a LEFT JOIN known k USING (n)""",
)
def registration(spark, sf):
    """Every second customer tells the nation that its node has, the others one by their number."""
    nation = S.table(spark, sf, "nation").select("n_nationkey", "n_name")
    named = lambda name: F.array(F.struct(F.lit("nation").alias("key"), name.alias("value")))
    s = S.table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    known = s.select(_name(F.col("s_suppkey")).alias("node_id"), F.concat(F.lit("10.0.0."), "s_suppkey").alias("rpc_address"), named(F.col("n_name")).alias("domains"), (F.col("s_suppkey") % 6 == 1).alias("dead"))
    k = F.col("c_custkey")
    own = known.select("node_id", F.col("domains").alias("own"))
    c = S.table(spark, sf, "customer").join(nation, k % 25 == F.col("n_nationkey")).withColumn("node_id", _name(k % 25 + 1)).join(own, "node_id", "left")
    domains = F.when(k % 2 == 0, F.col("own")).otherwise(named(F.col("n_name")))
    asked = c.select(k.alias("report_id"), "node_id", F.when(k % 4 == 0, "moved").otherwise(F.concat(F.lit("10.0.0."), (k % 25 + 1).cast("string"))).alias("address"), domains.alias("domains"))
    return R.registration(asked, known)


@query(
    "CRD2_membership_mutation",
    """WITH e AS (SELECT l_orderkey AS id, count(*) AS n, min(l_returnflag) AS kind FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey AS command_id, n = 1 AND kind = CASE WHEN o_orderstatus = 'F' THEN 'R' ELSE 'N' END AS accepted FROM orders JOIN e ON id = o_orderkey""",
)
def membership_mutation(spark, sf):
    """A mutation must have exactly one event, of the kind that is expected; an order's lines are a command's events."""
    events = S.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("command_id")).agg(F.count("*").alias("n"), F.min("l_returnflag").alias("kind"))
    asked = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("command_id"), F.when(F.col("o_orderstatus") == "F", "R").otherwise("N").alias("expected"))
    return asked.join(events, "command_id").select("command_id", ((F.col("n") == 1) & (F.col("kind") == F.col("expected"))).alias("accepted"))


@query(
    "CRD4_heartbeats",
    """WITH k AS (SELECT c_custkey AS n, c_custkey % 5 = 0 AS dead, c_custkey % 4 = 1 AS suspect, c_custkey % 3 = 0 AS ready FROM customer WHERE c_custkey % 6 <> 0)
    SELECT 'n' || c_custkey AS node_id, CASE WHEN n IS NULL THEN 'unknown' WHEN dead THEN 'dead' ELSE 'accepted' END AS outcome, coalesce(NOT dead AND suspect, false) AS turns_healthy, coalesce(NOT dead AND NOT ready, false) AS turns_ready FROM customer LEFT JOIN k ON n = c_custkey""",
)
def heartbeats(spark, sf):
    c, k = S.table(spark, sf, "customer"), F.col("c_custkey")
    known = c.where("c_custkey % 6 <> 0").select(_name(k).alias("node_id"), (k % 5 == 0).alias("dead"), F.when(k % 4 == 1, "suspect").otherwise("healthy").alias("state"), (k % 3 == 0).alias("ready"))
    return R.heartbeat_outcome(c.select(_name(k).alias("node_id")), known)


@query(
    "PLN23_recovery_entries",
    f"""WITH {ASSIGNED}, rep AS (SELECT slot, node_id FROM assigned WHERE slot % 3 = 1 UNION ALL SELECT DISTINCT slot, 'outsider' FROM assigned WHERE slot % 6 = 1),
    t AS (SELECT rep.slot, rep.node_id, CASE WHEN role IS NULL THEN 'drop' WHEN role IN ('tail', 'single') AND rep.slot % 4 <> 0 AND rep.slot % 5 <> 0 THEN 'resume' ELSE 'recover' END AS kind, coalesce(predecessor, successor) AS peer
    FROM rep LEFT JOIN assigned a ON a.slot = rep.slot AND a.node_id = rep.node_id)
    SELECT kind || '/' || node_id || '/' || slot AS id, slot, node_id, kind, CASE WHEN kind <> 'drop' THEN slot % 4 + 1 END AS slot_version, CASE WHEN kind = 'recover' THEN peer END AS source, 7 AS epoch, kind = 'recover' AND peer IS NULL AS failed FROM t""",
)
def recovery_entries(spark, sf):
    """Nodes report every third slot that they have, and an outsider some that it has not."""
    r = S.replicas(spark, sf)
    mine = r.where("slot % 3 = 1").select("slot", "node_id").unionByName(r.where("slot % 6 = 1").select("slot", F.lit("outsider").alias("node_id")).distinct())
    reported = mine.select("slot", "node_id", (F.col("slot") % 4 != 0).alias("has_data"), F.when(F.col("slot") % 5 != 0, "active").otherwise("leaving").alias("last_state"), F.lit(None).cast("string").alias("tail"))
    versions = r.select("slot").distinct().withColumn("slot_version", F.col("slot") % 4 + 1)
    return R.recovery_entries(C.recovery(reported, C.assignments(r)), versions, 7)


KINDS = ["drop", "resume", "add_tail", "update_peers"]
OUTBOX = """ob AS (SELECT 's' || o_orderkey AS id, o_custkey AS slot, ['drop', 'resume', 'add_tail', 'update_peers'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS kind, 'n' || (o_orderkey % 3) AS node_id, 3 AS epoch FROM orders),
out AS (SELECT * FROM ob WHERE kind IN ('drop', 'resume') UNION ALL SELECT 'r' || o_orderkey, o_custkey, 'add_tail', 'n' || (o_orderkey % 5), 9 FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'p' || c_custkey, c_custkey, 'update_peers', 'n0', 9 FROM customer)"""


@query("PLN22_rebuilt_outbox", f"WITH {OUTBOX} SELECT *, row_number() OVER (PARTITION BY slot ORDER BY kind, node_id, id) AS place FROM out")
def rebuilt_outbox(spark, sf):
    o, k = S.table(spark, sf, "orders"), F.col("o_orderkey")
    kind = F.array(*[F.lit(x) for x in KINDS])[(k % 4).cast("int")]
    stored = o.select(F.concat(F.lit("s"), k).alias("id"), F.col("o_custkey").alias("slot"), kind.alias("kind"), _name(k % 3).alias("node_id"), F.lit(3).cast("bigint").alias("epoch"))
    runtime = o.where("o_orderkey % 2 = 0").select(F.concat(F.lit("r"), k).alias("id"), F.col("o_custkey").alias("slot"), F.lit("add_tail").alias("kind"), _name(k % 5).alias("node_id"))
    refreshes = S.table(spark, sf, "customer").select(F.concat(F.lit("p"), "c_custkey").alias("id"), F.col("c_custkey").alias("slot"), F.lit("update_peers").alias("kind"), F.lit("n0").alias("node_id"))
    return R.rebuilt_outbox(stored, runtime, refreshes, 9)


COMMANDS = """cm AS (SELECT o_orderkey AS index, o_custkey AS slot, CASE WHEN o_orderkey % 300 = 299 THEN 'bootstrap' WHEN o_orderkey % 5 < 2 THEN 'reconfigure' WHEN o_orderkey % 5 = 2 THEN 'progress' WHEN o_orderkey % 5 = 3 THEN 'acknowledge_outbox' ELSE 'heartbeat' END AS kind FROM orders)"""


@query(
    "STM9_outbox_fold",
    f"""WITH {COMMANDS}, en AS (SELECT 'e' || index AS id, index, slot FROM cm WHERE kind = 'reconfigure')
    SELECT id, index, slot FROM en WHERE NOT EXISTS (SELECT 1 FROM cm WHERE cm.index > en.index AND cm.kind = 'bootstrap') AND NOT EXISTS (SELECT 1 FROM cm WHERE cm.index > en.index AND cm.slot = en.slot AND cm.kind IN ('reconfigure', 'progress'))
    AND NOT EXISTS (SELECT 1 FROM cm WHERE cm.kind = 'acknowledge_outbox' AND 'e' || (cm.index - 2) = en.id)""",
)
def outbox_fold(spark, sf):
    """Every plan sends an entry for its slot; an acknowledgement is of the command two before it."""
    k = F.col("o_orderkey")
    kind = F.when(k % 300 == 299, "bootstrap").when(k % 5 < 2, "reconfigure").when(k % 5 == 2, "progress").when(k % 5 == 3, "acknowledge_outbox").otherwise("heartbeat")
    commands = S.table(spark, sf, "orders").select(k.alias("index"), F.col("o_custkey").alias("slot"), kind.alias("kind"))
    entries = commands.where("kind = 'reconfigure'").select(F.concat(F.lit("e"), "index").alias("id"), "index", "slot")
    acknowledged = commands.where("kind = 'acknowledge_outbox'").select("index", F.concat(F.lit("e"), F.col("index") - 2).alias("id"))
    return R.outbox_fold(commands, entries, acknowledged)


@query(
    "CRD3_progress_reports",
    """WITH r AS (SELECT o_orderkey AS report_id, o_custkey AS slot, ['ready', 'removed'][CAST(o_orderkey % 2 AS INTEGER) + 1] AS kind, 'n' || (o_orderkey % 3) AS node_id,
    CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'c' || (o_orderkey % 2) END AS command_id, ['joining', 'leaving', 'active'][CAST(o_orderkey // 2 % 3 AS INTEGER) + 1] AS state FROM orders),
    p AS (SELECT c_custkey AS slot, ['ready', 'removed'][CAST(c_custkey % 2 AS INTEGER) + 1] AS kind, 'n' || (c_custkey % 3) AS node_id, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'c' || (c_custkey // 3 % 2) END AS command_id,
    CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 2 END AS slot_version FROM customer WHERE c_custkey % 6 <> 0),
    rec AS (SELECT l_orderkey AS slot, 'n' || (l_suppkey % 3) AS node_id, CASE WHEN l_returnflag = 'R' THEN 'removed' ELSE 'ready' END AS kind, l_linenumber AS version FROM lineitem),
    d AS (SELECT report_id, coalesce(bool_or(version = 2), false) OR count(version) = 1 AS done FROM r LEFT JOIN rec USING (slot, node_id, kind) GROUP BY report_id)
    SELECT r.report_id, CASE WHEN p.slot IS NULL OR p.kind <> r.kind OR p.node_id <> r.node_id THEN CASE WHEN done THEN 'duplicate' ELSE 'unexpected' END
    WHEN r.command_id <> '' AND p.command_id <> '' AND r.command_id <> p.command_id THEN 'wrong_command' WHEN p.slot_version <> 2 THEN 'wrong_version'
    WHEN state <> CASE r.kind WHEN 'ready' THEN 'joining' ELSE 'leaving' END THEN 'wrong_state' ELSE 'accepted' END AS outcome FROM r JOIN d USING (report_id) LEFT JOIN p USING (slot)""",
)
def progress_reports(spark, sf):
    k, c, s = F.col("o_orderkey"), F.col("c_custkey"), F.col("l_suppkey")
    one_of = lambda values, i: F.array(*[F.lit(v) for v in values])[i.cast("int")]
    kinds = ["ready", "removed"]
    reports = S.table(spark, sf, "orders").select(
        k.alias("report_id"), F.col("o_custkey").alias("slot"), one_of(kinds, k % 2).alias("kind"), _name(k % 3).alias("node_id"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("c"), (k % 2).cast("string"))).alias("command_id"),
        F.lit(2).alias("slot_version"), one_of(["joining", "leaving", "active"], F.floor(k / 2) % 3).alias("state"),
    )
    pending = S.table(spark, sf, "customer").where("c_custkey % 6 <> 0").select(
        c.alias("slot"), one_of(kinds, c % 2).alias("kind"), _name(c % 3).alias("node_id"), F.when(c % 7 == 0, "").otherwise(F.concat(F.lit("c"), (F.floor(c / 3) % 2).cast("string"))).alias("command_id"),
        F.when(c % 4 == 0, 1).otherwise(2).alias("slot_version"),
    )
    records = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("slot"), _name(s % 3).alias("node_id"), F.when(F.col("l_returnflag") == "R", "removed").otherwise("ready").alias("kind"), F.col("l_linenumber").alias("version"))
    return R.progress_report(reports, pending, records)


@query(
    "RUN9_what_if",
    """WITH rt AS (SELECT c_custkey AS runtime, c_custkey % 4 AS now FROM customer), ap AS (SELECT c_custkey AS runtime, 'c' || (c_custkey % 9) AS id, 'F' AS payload, c_custkey % 3 AS version FROM customer),
    cm AS (SELECT o_orderkey AS command_id, o_custkey AS runtime, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'c' || (o_orderkey % 9) END AS id, o_orderkey % 4 AS expected, o_orderstatus AS payload, o_orderkey % 13 <> 0 AS valid FROM orders),
    o AS (SELECT cm.*, now, ap.version AS version_then, CASE WHEN cm.id = '' OR NOT valid THEN 'invalid' WHEN ap.payload = cm.payload THEN 'duplicate' WHEN ap.payload IS NOT NULL THEN 'conflict' WHEN expected <> now THEN 'version_mismatch' ELSE 'applied' END AS outcome
    FROM cm JOIN rt USING (runtime) LEFT JOIN ap ON ap.runtime = cm.runtime AND ap.id = cm.id)
    SELECT command_id, outcome, CASE outcome WHEN 'duplicate' THEN version_then WHEN 'applied' THEN now + 1 END AS version FROM o""",
)
def what_if(spark, sf):
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    name = lambda x: F.concat(F.lit("c"), (x % 9).cast("string"))
    customer = S.table(spark, sf, "customer")
    commands = S.table(spark, sf, "orders").select(
        k.alias("command_id"), F.col("o_custkey").alias("runtime"), F.when(k % 17 == 0, "").otherwise(name(k)).alias("id"), (k % 4).alias("expected"), F.col("o_orderstatus").alias("payload"), (k % 13 != 0).alias("valid")
    )
    applied = customer.select(c.alias("runtime"), name(c).alias("id"), F.lit("F").alias("payload"), (c % 3).alias("version"))
    return R.evaluated(commands, applied, customer.select(c.alias("runtime"), (c % 4).alias("version")))
