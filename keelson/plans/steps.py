"""Queries of reconfiguration steps, progress, commands and the commit side of replicas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators import control as C
from keelson.operators import log as L
from keelson.operators import steps as P
from keelson.plans.control import FACTOR, REPLICAS
from keelson.plans.log import CUTS, HOLES, LOG, _cuts, _log
from keelson.plans.names import query
from keelson.sources import tables as S

#: Replicas that a chain of these tables has when it is full.
WIDE = 4
# chains with what is wanted of them: the same, the first or the last member replaced, or turned round; every 7th node is draining, every 13th dead
CHAINS = f"""{REPLICAS}, c AS (SELECT slot, list(node_id ORDER BY pos) AS members, coalesce(list(node_id ORDER BY pos) FILTER (state = 'active'), []) AS actives, bool_or(state <> 'active') AS pending,
    bool_or(state = 'active' AND n % 7 = 5) AS draining, bool_or(n % 13 = 6) AS dead FROM replicas GROUP BY slot),
w AS (SELECT *, CASE slot % 5 WHEN 0 THEN actives WHEN 1 THEN list_append(actives[2:], 'new') WHEN 2 THEN list_append(actives[:-2], 'new') WHEN 3 THEN list_reverse(actives) ELSE ['x', 'y', 'z', 'u'] END AS wanted FROM c)"""


def _wanted(spark, sf) -> DataFrame:
    r = S.replicas(spark, sf).withColumn("drains", F.col("n") % 7 == 5).withColumn("gone", F.col("n") % 13 == 6)
    flags = r.groupBy("slot").agg(F.bool_or((F.col("state") == "active") & F.col("drains")).alias("draining"), F.bool_or("gone").alias("dead"), F.bool_or(F.col("state") != "active").alias("pending"))
    c = C.chains(r).select("slot", C.members("chain").alias("members"), C.members("chain", "active").alias("actives")).join(flags, "slot")
    a, new, k = F.col("actives"), F.array(F.lit("new")), F.col("slot") % 5
    but_first, but_last = F.slice(a, 2, F.greatest(F.size(a), F.lit(1))), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    wanted = F.when(k == 0, a).when(k == 1, F.concat(but_first, new)).when(k == 2, F.concat(but_last, new)).when(k == 3, F.reverse(a)).otherwise(F.array(*[F.lit(x) for x in "xyzu"]))
    return c.withColumn("wanted", wanted)


_SAME = "list_filter(actives, lambda x: x <> removed) = list_filter(wanted, lambda x: x <> added)"
_DIFF = "list_filter({a}, lambda x: NOT list_contains({b}, x))"


@query(
    "PLN11_join_append",
    f"""WITH {CHAINS}, f AS (SELECT *, {_DIFF.format(a="wanted", b="actives")} AS plus, {_DIFF.format(a="actives", b="wanted")} AS minus FROM w WHERE NOT pending AND NOT draining AND NOT dead AND len(actives) = {WIDE} AND len(wanted) = {WIDE}),
    g AS (SELECT *, plus[1] AS added, minus[1] AS removed, len(plus) = 1 AND len(minus) = 1 AS one FROM f)
    SELECT slot, CASE WHEN one THEN 'append' ELSE 'disjoint' END AS outcome, CASE WHEN one THEN added END AS added, CASE WHEN one THEN removed END AS removed FROM g WHERE (one AND {_SAME}) OR (NOT one AND NOT list_has_any(actives, wanted))""",
)
def join_append(spark, sf):
    return P.join_append(_wanted(spark, sf), WIDE)


# one member too many: the last active one is new, and one of the others is no longer wanted
JOINED = f"""{CHAINS}, j AS (SELECT slot, pending, draining, list_append(actives, 'new') AS actives, CASE slot % 3 WHEN 0 THEN list_append(actives[2:], 'new') WHEN 1 THEN list_prepend('new', actives[:-2]) ELSE list_append(list_reverse(actives)[2:], 'new') END AS wanted FROM w WHERE len(actives) = {WIDE})"""


def _joined(spark, sf) -> DataFrame:
    a, new, k = F.col("actives"), F.array(F.lit("new")), F.col("slot") % 3
    wanted = F.when(k == 0, F.concat(F.slice(a, 2, WIDE), new)).when(k == 1, F.concat(new, F.slice(a, 1, WIDE - 1))).otherwise(F.concat(F.slice(F.reverse(a), 2, WIDE), new))
    return _wanted(spark, sf).where(F.size("actives") == WIDE).withColumn("wanted", wanted).withColumn("actives", F.concat("actives", new))


@query(
    "PLN10_join_finalization",
    f"""WITH {JOINED}, e AS (SELECT *, {_DIFF.format(a="actives", b="wanted")} AS extra FROM j WHERE NOT pending AND NOT draining)
    SELECT slot, extra[1] AS leaving FROM e WHERE len(extra) = 1 AND extra[1] <> 'new' AND list_contains(wanted, 'new') AND list_filter(actives, lambda x: x <> extra[1] AND x <> 'new') = list_filter(wanted, lambda x: x <> 'new')""",
)
def join_finalization(spark, sf):
    return P.join_finalization(_joined(spark, sf), WIDE)


@query("SET8_order_after_join", f"WITH {JOINED}, e AS (SELECT *, {_DIFF.format(a='actives', b='wanted')} AS extra FROM j) SELECT slot, list_filter(actives, lambda x: x <> extra[1] AND x <> 'new') = list_filter(wanted, lambda x: x <> 'new') AS same FROM e WHERE len(extra) = 1")
def order_after_join(spark, sf):
    j = _joined(spark, sf).withColumn("extra", P.one_more(F.col("actives"), F.col("wanted"))).where("extra is not null")
    return j.select("slot", P.same_order_after_join(F.col("actives"), F.col("extra"), F.lit("new"), F.col("wanted")).alias("same"))


@query("SET4_one_more", f"WITH {JOINED}, e AS (SELECT slot, {_DIFF.format(a='actives', b='wanted')} AS extra FROM j) SELECT slot, CASE WHEN len(extra) = 1 THEN extra[1] END AS extra FROM e")
def one_more(spark, sf):
    return _joined(spark, sf).select("slot", P.one_more(F.col("actives"), F.col("wanted")).alias("extra"))


@query("SET5_one_replaced", f"WITH {CHAINS}, f AS (SELECT slot, {_DIFF.format(a='wanted', b='actives')} AS plus, {_DIFF.format(a='actives', b='wanted')} AS minus FROM w) SELECT slot, plus[1] AS added, minus[1] AS removed FROM f WHERE len(plus) = 1 AND len(minus) = 1")
def one_replaced(spark, sf):
    a, w = F.col("actives"), F.col("wanted")
    return _wanted(spark, sf).select("slot", P.one_more(w, a).alias("added"), P.one_more(a, w).alias("removed")).where("added is not null and removed is not null")


@query("SET6_disjoint", f"WITH {CHAINS} SELECT slot, NOT list_has_any(actives, wanted) AS apart FROM w")
def disjoint(spark, sf):
    return _wanted(spark, sf).select("slot", (~F.arrays_overlap("actives", "wanted")).alias("apart"))


@query("SET7_order_without", f"WITH {CHAINS}, f AS (SELECT *, {_DIFF.format(a='wanted', b='actives')} AS plus, {_DIFF.format(a='actives', b='wanted')} AS minus FROM w) SELECT slot, list_filter(actives, lambda x: x <> minus[1]) = list_filter(wanted, lambda x: x <> plus[1]) AS same FROM f WHERE len(plus) = 1 AND len(minus) = 1")
def order_without(spark, sf):
    a, w = F.col("actives"), F.col("wanted")
    one = _wanted(spark, sf).withColumn("plus", P.one_more(w, a)).withColumn("minus", P.one_more(a, w)).where("plus is not null and minus is not null")
    return one.select("slot", (P.without(a, F.col("minus")) == P.without(w, F.col("plus"))).alias("same"))


@query("SET11_membership", f"WITH {CHAINS} SELECT slot, list_contains(members, wanted[1]) AS inside FROM w WHERE len(wanted) > 0")
def membership(spark, sf):
    return _wanted(spark, sf).where(F.size("wanted") > 0).select("slot", F.array_contains("members", F.col("wanted")[0]).alias("inside"))


@query(
    "PLN12_missing_append",
    f"""WITH {CHAINS}, h AS (SELECT slot, pending, members[1:CAST(slot % 4 AS INTEGER) + 1] AS members FROM w), s AS (SELECT slot, pending, members, list_append(members, CASE slot % 3 WHEN 0 THEN members[1] WHEN 1 THEN 'Supplier#000000002' ELSE 'nobody' END) AS wanted FROM h WHERE len(members) < {WIDE})
    SELECT slot, wanted[len(members) + 1] AS node_id, CASE WHEN len(wanted) >= {WIDE} THEN wanted[{WIDE}] ELSE '' END AS replaced FROM s JOIN nodes n ON n.node_id = wanted[len(members) + 1] WHERE NOT pending AND n.n % 7 <> 5 AND NOT list_contains(members, wanted[len(members) + 1])""",
)
def missing_append(spark, sf):
    nodes = S.nodes(spark, sf)
    k = F.col("slot") % 3
    first = F.slice("members", F.lit(1), (F.col("slot") % 4 + 1).cast("int"))
    short = _wanted(spark, sf).withColumn("members", first).where(F.size("members") < WIDE)
    wanted = F.concat("members", F.array(F.when(k == 0, F.col("members")[0]).when(k == 1, "Supplier#000000002").otherwise("nobody")))
    return P.missing_append(short.withColumn("wanted", wanted), nodes.where("n % 7 <> 5"), WIDE)


@query(
    "PLN9_drain_finalization",
    f"""WITH {REPLICAS}, d AS (SELECT slot, coalesce(list(node_id ORDER BY pos) FILTER (state = 'active' AND n % 3 <> 1), []) AS kept, coalesce(list(node_id ORDER BY pos) FILTER (state = 'active' AND n % 3 = 1), []) AS leaving, bool_or(state = 'joining') AS joining FROM replicas GROUP BY slot)
    SELECT slot, array_to_string(kept, ',') AS kept, array_to_string(leaving, ',') AS leaving FROM d WHERE NOT joining AND len(leaving) > 0 AND len(kept) = {FACTOR}""",
)
def drain_finalization(spark, sf):
    out = P.drain_finalization(S.replicas(spark, sf), S.nodes(spark, sf).where("n % 3 = 1"), FACTOR)
    return out.select("slot", F.array_join("kept", ",").alias("kept"), F.array_join("leaving", ",").alias("leaving"))


# orders are progress reports about the nodes of slots
EVENTS = """ev AS (SELECT o_orderkey AS event_id, CASE o_orderkey % 5 WHEN 0 THEN 'became_active' WHEN 1 THEN 'removed' WHEN 2 THEN 'became_active' WHEN 3 THEN 'removed' ELSE 'paused' END AS kind, o_custkey - 3 AS slot,
    CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'Supplier#' || lpad(CAST(o_orderkey % 10 + 1 AS VARCHAR), 9, '0') END AS node_id FROM orders)"""
OUTCOME = f"""WITH {REPLICAS}, {EVENTS}, st AS (SELECT ev.*, state, nn.n % 4 = 2 AS dead FROM ev LEFT JOIN replicas r USING (slot, node_id) LEFT JOIN nodes nn ON nn.node_id = ev.node_id),
oc AS (SELECT event_id, kind, CASE WHEN kind NOT IN ('became_active', 'removed') THEN 'unsupported_event' WHEN slot < 0 OR slot >= 140 THEN 'invalid_slot' WHEN node_id = '' THEN 'empty_node' WHEN state IS NULL THEN 'not_in_chain'
    WHEN kind = 'became_active' AND state <> 'joining' THEN 'not_joining' WHEN kind = 'removed' AND state <> 'leaving' AND NOT coalesce(dead, false) THEN 'not_removable' ELSE 'applied' END AS outcome FROM st)"""


def _progress(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 5 == 4, "paused").when((k % 5 == 0) | (k % 5 == 2), "became_active").otherwise("removed")
    node = F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("Supplier#"), F.lpad((k % 10 + 1).cast("string"), 9, "0")))
    events = S.table(spark, sf, "orders").select(k.alias("event_id"), kind.alias("kind"), (F.col("o_custkey") - 3).alias("slot"), node.alias("node_id"))
    return P.progress_outcome(events, S.replicas(spark, sf), S.nodes(spark, sf).where("n % 4 = 2"), 140)


@query("PLN6_progress_validation", f"{OUTCOME} SELECT event_id, outcome FROM oc")
def progress_validation(spark, sf):
    return _progress(spark, sf).select("event_id", "outcome")


@query("PLN5_progress_applied", f"{OUTCOME} SELECT event_id, CASE kind WHEN 'became_active' THEN 'active' ELSE 'gone' END AS next FROM oc WHERE outcome = 'applied'")
def progress_applied(spark, sf):
    return _progress(spark, sf).where("outcome = 'applied'").select("event_id", "next")


# an order's lines are the steps planned for its slot
PLANS = """st AS (SELECT l_orderkey AS slot, list({'kind': CASE WHEN l_returnflag = 'R' THEN 'mark_leaving' WHEN l_returnflag = 'A' THEN 'append_tail' ELSE 'refresh' END, 'node_id': CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE 'n' || l_suppkey END} ORDER BY l_linenumber, l_suppkey, l_partkey, l_returnflag) AS steps FROM lineitem GROUP BY l_orderkey)"""


def _plans(spark, sf) -> DataFrame:
    li = S.table(spark, sf, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "mark_leaving").when(F.col("l_returnflag") == "A", "append_tail").otherwise("refresh")
    step = F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", kind.alias("kind"), F.when(F.col("l_suppkey") % 9 == 0, "").otherwise(F.concat(F.lit("n"), "l_suppkey")).alias("node_id"))
    return li.groupBy(F.col("l_orderkey").alias("slot")).agg(F.array_sort(F.collect_list(step)).alias("steps"))


_KINDS = "list_transform(steps, lambda s: s.kind)"


@query("AGG45_step_kinds", f"WITH {PLANS}, k AS (SELECT slot, unnest({_KINDS}) AS kind, generate_subscripts(steps, 1) AS i FROM st), f AS (SELECT slot, kind, min(i) AS i FROM k GROUP BY ALL) SELECT slot, string_agg(kind, ',' ORDER BY i) AS kinds FROM f GROUP BY slot")
def step_kinds(spark, sf):
    return _plans(spark, sf).select("slot", F.array_join(P.distinct_kinds(F.col("steps")), ",").alias("kinds"))


@query("FLT22_one_step_kind", f"WITH {PLANS} SELECT slot, len(list_distinct({_KINDS})) = 1 AND steps[1].kind = 'append_tail' AS only_appends FROM st")
def one_step_kind(spark, sf):
    return _plans(spark, sf).select("slot", F.forall("steps", lambda s: s["kind"] == "append_tail").alias("only_appends"))


PENDING = f"""{PLANS}, old AS (SELECT o_orderkey AS slot, 'n' || o_custkey AS node_id, CASE WHEN o_orderstatus = 'F' THEN 'ready' ELSE 'removed' END AS kind FROM orders WHERE o_orderkey % 3 = 0),
new AS (SELECT slot, steps[1].node_id AS node_id, CASE WHEN len(list_distinct({_KINDS})) = 1 THEN CASE steps[1].kind WHEN 'append_tail' THEN 'ready' WHEN 'mark_leaving' THEN 'removed' END END AS kind FROM st WHERE slot % 2 = 0)"""


@query("RUN12_pending_from_plan", f"WITH {PENDING} SELECT * FROM new WHERE kind IS NOT NULL AND node_id <> ''")
def pending_from_plan(spark, sf):
    none = S.table(spark, sf, "orders").limit(0).select(F.col("o_orderkey").alias("slot"), F.lit("").alias("node_id"), F.lit("").alias("kind"))
    return P.pending_after(none, _plans(spark, sf).where("slot % 2 = 0"), none)


@query("STM8_pending_work", f"WITH {PENDING}, u AS (SELECT * FROM old WHERE slot NOT IN (SELECT slot FROM new) UNION ALL SELECT * FROM new WHERE kind IS NOT NULL AND node_id <> '') SELECT * FROM u WHERE slot % 5 <> 0")
def pending_work(spark, sf):
    o = S.table(spark, sf, "orders")
    old = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("slot"), F.concat(F.lit("n"), "o_custkey").alias("node_id"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("removed").alias("kind"))
    plans = _plans(spark, sf)
    return P.pending_after(old, plans.where("slot % 2 = 0"), plans.where("slot % 5 = 0").unionByName(old.where("slot % 5 = 0").select("slot", F.lit(None).cast(plans.schema["steps"].dataType).alias("steps"))))


@query("SET10_other_slots_stay", "SELECT o_orderkey AS id, o_custkey AS slot FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 6 = 0)")
def other_slots_stay(spark, sf):
    entries = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("slot"))
    progressed = S.table(spark, sf, "customer").where("c_custkey % 6 = 0").select(F.col("c_custkey").alias("slot"))
    return entries.join(progressed, "slot", "left_anti").select("id", "slot")


KINDS = ["bootstrap", "reconfigure", "progress", "node_ready", "heartbeat", "liveness", "acknowledge_outbox"]
_LIST = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"


@query(
    "FLT20_command_payload",
    f"""WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'other' ELSE {_LIST}[CAST(o_orderkey % 7 AS INTEGER) + 1] END AS kind, CASE o_orderkey % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [{_LIST}[CAST(o_orderkey % 7 AS INTEGER) + 1], 'progress'] ELSE [{_LIST}[CAST(o_orderkey % 7 AS INTEGER) + 1]] END AS p FROM orders)
    SELECT id, CASE WHEN kind = 'other' THEN 'unsupported_kind' WHEN NOT list_contains(p, kind) THEN 'no_payload' WHEN len(p) > 1 THEN 'other_payload' END AS problem FROM c""",
)
def command_payload(spark, sf):
    k = F.col("o_orderkey")
    own = F.array(*[F.lit(x) for x in KINDS])[(k % 7).cast("int")]
    payloads = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(own, F.lit("progress"))).otherwise(F.array(own))
    return P.payload_problem(S.table(spark, sf, "orders").select(k.alias("id"), F.when(k % 13 == 0, "other").otherwise(own).alias("kind"), payloads.alias("payloads")), KINDS)


@query(
    "CRD6_completed_match",
    """WITH r AS (SELECT l_orderkey AS slot, l_suppkey % 3 AS node_id, l_returnflag AS kind, l_linenumber AS version FROM lineitem), a AS (SELECT o_orderkey AS asked_id, o_orderkey AS slot, o_custkey % 3 AS node_id, CASE WHEN o_orderstatus = 'F' THEN 'R' ELSE 'N' END AS kind, 2 AS version FROM orders)
    SELECT asked_id, coalesce(bool_or(r.version = a.version), false) OR count(r.version) = 1 AS matches FROM a LEFT JOIN r USING (slot, node_id, kind) GROUP BY asked_id""",
)
def completed_match(spark, sf):
    records = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("slot"), (F.col("l_suppkey") % 3).alias("node_id"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("version"))
    asked = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("asked_id"), F.col("o_orderkey").alias("slot"), (F.col("o_custkey") % 3).alias("node_id"), F.when(F.col("o_orderstatus") == "F", "R").otherwise("N").alias("kind"), F.lit(2).alias("version"))
    return P.completed_match(records, asked)


@query("RUN7_acknowledgements", "WITH e AS (SELECT o_orderkey AS entry_id FROM orders WHERE o_orderkey % 3 = 0) SELECT l_orderkey AS command_id, count(e.entry_id) AS found, count(e.entry_id) > 0 AS changes FROM lineitem LEFT JOIN e ON e.entry_id = l_orderkey + l_linenumber GROUP BY l_orderkey")
def acknowledgements(spark, sf):
    entries = S.table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("entry_id"))
    return P.acknowledged(entries, S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("command_id"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("entry_id")))


@query("RUN10_replay_problems", "SELECT o_custkey AS id, o_orderkey AS index FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS f FROM orders) WHERE o_orderkey > f")
def replay_problems(spark, sf):
    return P.replay_problems(S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("index"), F.col("o_custkey").alias("id")))


# --- the commit side of replicas: commits are told in another order, twice, and at times by another source

COMMITS = f"""{LOG}, {HOLES}, {CUTS}, told AS (SELECT slot, sequence, arrival AS arrival, CASE WHEN arrival % 23 = 4 THEN 'b' ELSE 'a' END AS source FROM log UNION ALL SELECT slot, sequence, arrival + 1000000000, CASE WHEN arrival % 17 = 3 THEN 'b' ELSE 'a' END FROM log WHERE arrival % 3 = 0),
kept AS (SELECT log.slot, sequence FROM log JOIN cuts USING (slot) WHERE sequence <= local_sequence AND sequence > local_sequence - 64)"""


def _told(log: DataFrame) -> DataFrame:
    by = lambda n, k, late: log.select("slot", "sequence", (F.col("arrival") + late).alias("arrival"), F.when(F.col("arrival") % n == k, "b").otherwise("a").alias("source"))
    again = log.where("arrival % 3 = 0").select("slot", "sequence", (F.col("arrival") + 1_000_000_000).alias("arrival"), F.when(F.col("arrival") % 17 == 3, "b").otherwise("a").alias("source"))
    return by(23, 4, 0).unionByName(again)


@query(
    "STF4_commit_reducer",
    f"""{COMMITS} SELECT t.slot, t.sequence, CASE WHEN t.sequence <= local_sequence THEN CASE WHEN kept.slot IS NULL THEN 'too_old' WHEN source = 'a' THEN 'ignore' ELSE 'conflict' END WHEN t.sequence > local_sequence + 1 OR holes.slot IS NULL THEN 'buffer' ELSE 'apply' END AS outcome
    FROM told t JOIN cuts USING (slot) LEFT JOIN kept ON kept.slot = t.slot AND kept.sequence = t.sequence LEFT JOIN holes ON holes.slot = t.slot AND holes.sequence = t.sequence""",
)
def commit_reducer(spark, sf):
    log = _log(spark, sf)
    cuts = _cuts(log).select("slot", F.col("local_sequence").alias("committed"))
    kept = log.join(cuts, "slot").where("sequence <= committed and sequence > committed - 64").select("slot", "sequence", F.lit("a").alias("source"))
    return P.commit_outcome(_told(log), cuts, log.where("arrival % 37 <> 20"), kept)


@query("STF6_late_commits", f"{COMMITS} SELECT t.slot, count(*) FILTER (kept.slot IS NULL) AS too_old, count(*) FILTER (kept.slot IS NOT NULL AND source = 'b') AS conflicts FROM told t JOIN cuts ON cuts.slot = t.slot AND t.sequence <= local_sequence LEFT JOIN kept ON kept.slot = t.slot AND kept.sequence = t.sequence GROUP BY t.slot")
def late_commits(spark, sf):
    late = commit_reducer(spark, sf).where("outcome in ('too_old', 'conflict', 'ignore')")
    return late.groupBy("slot").agg(F.count_if(F.col("outcome") == "too_old").alias("too_old"), F.count_if(F.col("outcome") == "conflict").alias("conflicts"))


@query(
    "STF8_commit_buffer",
    f"""{COMMITS}, f AS (SELECT t.*, row_number() OVER w AS nth, first_value(source) OVER w AS held FROM told t JOIN cuts USING (slot) WHERE sequence > local_sequence + 1 WINDOW w AS (PARTITION BY t.slot, sequence ORDER BY arrival)),
    p AS (SELECT slot, sequence FROM (SELECT slot, sequence, row_number() OVER (PARTITION BY slot ORDER BY arrival) AS place FROM f WHERE nth = 1) WHERE place <= 12)
    SELECT f.slot, f.sequence, f.arrival, CASE WHEN p.slot IS NULL THEN 'backpressure' WHEN nth = 1 THEN 'buffer' WHEN held = source THEN 'ignore' ELSE 'conflict' END AS outcome FROM f LEFT JOIN p ON p.slot = f.slot AND p.sequence = f.sequence""",
)
def commit_buffer(spark, sf):
    log = _log(spark, sf)
    return P.buffered_commits(_told(log), _cuts(log).select("slot", F.col("local_sequence").alias("committed")), 12)


@query("STF9_applied_commit", f"{LOG}, {CUTS} SELECT cuts.slot, tail_sequence AS committed, count(DISTINCT key) AS dirty_keys FROM cuts LEFT JOIN log ON log.slot = cuts.slot AND sequence > tail_sequence GROUP BY ALL")
def applied_commit(spark, sf):
    log = _log(spark, sf)
    return P.applied_commit(_cuts(log).select("slot", F.col("tail_sequence").alias("committed")), log)


@query("STF19_pruned_overlay", f"{LOG}, {CUTS} SELECT log.slot, key, max(sequence) AS sequence FROM log JOIN cuts USING (slot) WHERE sequence > local_sequence GROUP BY ALL HAVING max(sequence) > max(tail_sequence)")
def pruned_overlay(spark, sf):
    """Overlay entries (the newest of a key) that stay after all up to the tail's sequence is materialized."""
    log = _log(spark, sf)
    over = L.latest(log.join(_cuts(log), "slot").where("sequence > local_sequence"))
    return over.join(_cuts(log), "slot").where("sequence > tail_sequence").select("slot", "key", "sequence")


@query("STF14_commit_advance", f"{LOG}, {CUTS}, {HOLES}, p AS (SELECT slot, max(sequence) AS prepared FROM holes GROUP BY slot) SELECT slot, CAST(greatest(local_sequence, least(tail_sequence, coalesce(prepared, 0))) AS BIGINT) AS committed, greatest(local_sequence, least(tail_sequence, coalesce(prepared, 0))) > local_sequence AS advances FROM cuts LEFT JOIN p USING (slot)")
def commit_advance(spark, sf):
    """A cumulative advance jumps to the told sequence, as far as it is prepared, and never back."""
    log = _log(spark, sf)
    prepared = log.where("arrival % 37 <> 20").groupBy("slot").agg(F.max("sequence").alias("prepared"))
    to = F.greatest("local_sequence", F.least("tail_sequence", F.coalesce("prepared", F.lit(0))))
    return _cuts(log).join(prepared, "slot", "left").select("slot", to.cast("bigint").alias("committed"), (to > F.col("local_sequence")).alias("advances"))


# --- liveness: a user's last event is a node's last heartbeat

@query(
    "STM4_liveness_evaluation",
    """WITH b AS (SELECT 'node-' || user_id AS node_id, (epoch_us(TIMESTAMP '2024-01-30') - epoch_us(max(ts))) / 1e6 AS age, max(user_id) AS u, count(*) FILTER (event_type = 'error') % 4 AS flaps FROM events GROUP BY user_id),
    t AS (SELECT *, CASE WHEN age >= 172800 THEN 'dead' WHEN age >= 43200 THEN 'suspect' ELSE 'healthy' END AS target, CASE u % 3 WHEN 0 THEN 'healthy' WHEN 1 THEN 'suspect' ELSE 'dead' END AS state FROM b),
    e AS (SELECT *, target <> state AND target = 'suspect' AND flaps + 1 >= 3 AS evicted FROM t), x AS (SELECT *, CASE WHEN evicted THEN 'dead' ELSE target END AS next FROM e)
    SELECT node_id, next, evicted, CASE WHEN next = 'dead' AND u % 5 <> 0 THEN CASE WHEN u % 2 = 0 THEN 'settled' ELSE 'mark_dead' END END AS action FROM x""",
)
def liveness_evaluation(spark, sf):
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    b = S.table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last"), (F.count_if(F.col("event_type") == "error") % 4).alias("flaps"))
    u = F.col("user_id")
    nodes = b.select(
        F.concat(F.lit("node-"), u).alias("node_id"), F.when(u % 3 == 0, "healthy").when(u % 3 == 1, "suspect").otherwise("dead").alias("state"),
        ((micros(F.lit("2024-01-30").cast("timestamp_ntz")) - micros(F.col("last"))) / 1e6).alias("age_s"), "flaps", (u % 5 == 0).alias("dead_action_fired"), (u % 2 == 0).alias("known_dead"),
    )
    return P.liveness_evaluation(nodes, 43_200, 172_800, 3, False)


@query("FLT10_cluster_ready", f"WITH {REPLICAS}, s AS (SELECT slot, count(*) = {FACTOR} AND bool_and(state = 'active') AS settled FROM replicas GROUP BY slot) SELECT count(*) AS slots, count(*) FILTER (settled) AS settled, count(*) = count(*) FILTER (settled) AS ready FROM s")
def cluster_ready(spark, sf):
    s = C.chains(S.replicas(spark, sf)).select(C.settled("chain", FACTOR).alias("settled"))
    return s.agg(F.count("*").alias("slots"), F.count_if("settled").alias("settled")).withColumn("ready", F.col("slots") == F.col("settled"))


@query("FLT16_lease_valid", "SELECT o_orderkey AS seq, o_custkey % 4 = 1 AND o_totalprice > 100000 AS owned, CASE WHEN o_totalprice <= 100000 THEN 'expired' WHEN o_custkey % 4 <> 1 THEN 'other_holder' END AS refused FROM orders")
def lease_valid(spark, sf):
    """A lease is one's own if one holds it and it has not run out; an order's price is what is left of it."""
    left, mine = F.col("o_totalprice") > 100_000, F.col("o_custkey") % 4 == 1
    return S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), (mine & left).alias("owned"), F.when(~left, "expired").when(~mine, "other_holder").alias("refused"))


@query("CRD7_marked_unavailable", f"WITH {REPLICAS} SELECT slot, node_id FROM replicas WHERE n % 5 = 1 AND NOT (slot % 4 = 2)")
def marked_unavailable(spark, sf):
    """All slots that a recovered node reports are unavailable there, until each is cleared."""
    r = S.replicas(spark, sf)
    cleared = r.where("slot % 4 = 2").select("slot", "node_id")
    return r.where("n % 5 = 1").select("slot", "node_id").join(cleared, ["slot", "node_id"], "left_anti")
