"""Control plane as relations: chains, routes, placement checks, recovery, liveness, commands and outboxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.functions.conditions import first_reason


def assignments(replicas: DataFrame) -> DataFrame:
    """(slot, pos, node_id, state, role, predecessor, successor, tail): role by place, tail the last active replica.

    A chain has a handful of replicas, so its window is never large; one
    shuffle by slot serves all columns.
    """
    whole = W.partitionBy("slot")
    w = whole.orderBy("pos")
    n, i = F.count("*").over(whole), F.row_number().over(w)
    role = F.when(n == 1, "single").when(i == 1, "head").when(i == n, "tail").otherwise("middle")
    tail = F.max_by(F.when(F.col("state") == "active", F.col("node_id")), F.when(F.col("state") == "active", F.col("pos"))).over(whole)
    return replicas.select("slot", "pos", "node_id", "state", role.alias("role"), F.lag("node_id").over(w).alias("predecessor"), F.lead("node_id").over(w).alias("successor"), tail.alias("tail"))


def chains(replicas: DataFrame) -> DataFrame:
    """(slot, chain): the replicas of each slot in order, as an array."""
    return replicas.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id", "state"))).alias("chain"))


def members(chain: str | Column, state: str | None = None) -> Column:
    """Node ids of a chain, of one state if given."""
    c = F.col(chain) if isinstance(chain, str) else chain
    return F.transform(c if state is None else F.filter(c, lambda r: r["state"] == state), lambda r: r["node_id"])


def settled(chain: str, factor: int) -> Column:
    """All replicas active, and as many as there should be."""
    return F.forall(chain, lambda r: r["state"] == "active") & (F.size(chain) == factor)


def routes(replicas: DataFrame, unavailable: DataFrame, refreshing: DataFrame) -> DataFrame:
    """(slot, head, tail, read_replicas, readable, writable): served by active replicas; a joining one stops writes.

    An unavailable active replica (node_id, slot) blanks its slot's whole
    route; so does a slot whose peers are being refreshed.
    """
    active = members("chain", "active")
    hurt = replicas.where("state = 'active'").join(unavailable, ["node_id", "slot"], "left_semi").select("slot").union(refreshing.select("slot")).distinct().withColumn("blank", F.lit(True))
    c = chains(replicas).join(hurt, "slot", "left").withColumn("active", F.when(F.col("blank"), F.array().cast("array<string>")).otherwise(active))
    there = F.size("active") > 0
    return c.select("slot", F.try_element_at("active", F.lit(1)).alias("head"), F.try_element_at("active", F.lit(-1)).alias("tail"), F.col("active").alias("read_replicas"), there.alias("readable"), (there & ~F.exists("chain", lambda r: r["state"] == "joining")).alias("writable"))


def routed(keys: DataFrame, slots: DataFrame) -> DataFrame:
    """Keys with the route of their slot; Spark broadcasts the routes if they are small."""
    return keys.join(slots, "slot", "left")


def write_check(known: Column, active: Column, version_ok: Column, role: Column) -> Column:
    """Why a write is refused, in this order; null if it is not."""
    return first_reason((~known, "unknown_slot"), (~active, "inactive"), (~version_ok, "wrong_version"), (~role.isin("head", "single"), "wrong_role"))


def read_check(known: Column, active: Column, version_ok: Column) -> Column:
    return first_reason((~known, "unknown_slot"), (~active, "inactive"), (~version_ok, "wrong_version"))


def read_targets(read_replicas: Column, tail: Column) -> Column:
    return F.when(F.size(read_replicas) > 0, read_replicas).otherwise(F.array(tail))


def eligible(nodes: DataFrame, replicas: DataFrame) -> DataFrame:
    """(slot, node_id): nodes that may join a chain: not in it, and sharing no failure domain with it.

    The conflict is an equi-join on (key, value) of exploded domains. The answer
    may hold every node for every slot, so ask for slots that need one.
    """
    ranked = nodes.select("node_id", (F.row_number().over(W.orderBy("node_id")) - 1).alias("rank"))
    pairs = replicas.select("slot").distinct().select("slot", F.explode(F.sequence(F.lit(0), F.lit(nodes.count() - 1))).alias("rank")).join(ranked, "rank").select("slot", "node_id")
    domains = nodes.select("node_id", F.explode("domains").alias("k", "v"))
    held = replicas.select("slot", "node_id").join(domains, "node_id").select("slot", "k", "v").distinct()
    clash = domains.join(held, ["k", "v"]).select("slot", "node_id").distinct()
    return pairs.join(clash, ["slot", "node_id"], "left_anti").join(replicas.select("slot", "node_id"), ["slot", "node_id"], "left_anti")


def load(replicas: DataFrame) -> DataFrame:
    """(node_id, heads, tails, replicas) of each node."""
    whole = W.partitionBy("slot")
    r = replicas.withColumn("first", F.min("pos").over(whole)).withColumn("last", F.max("pos").over(whole))
    return r.groupBy("node_id").agg(F.count_if(F.col("pos") == F.col("first")).alias("heads"), F.count_if(F.col("pos") == F.col("last")).alias("tails"), F.count("*").alias("replicas"))


def best_candidates(candidates: DataFrame, loads: DataFrame) -> DataFrame:
    """(slot, node_id): of each slot's candidates the one with the fewest tails, heads and replicas, then by id."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rated = candidates.join(loads, "node_id", "left").select("slot", F.struct(zero("tails"), zero("heads"), zero("replicas"), "node_id").alias("rate"))
    return rated.groupBy("slot").agg(F.min("rate")["node_id"].alias("node_id"))


def rotation(slots: DataFrame, nodes: DataFrame) -> DataFrame:
    """(slot, pos, node_id) where every node has every slot: the sorted ids, turned by the slot. Nodes are few."""
    ranked = nodes.select("node_id", (F.row_number().over(W.orderBy("node_id")) - 1).alias("rank"))
    n = nodes.count()
    places = slots.select("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pos"))
    return places.withColumn("rank", F.pmod(F.col("slot") + F.col("pos"), F.lit(n)).cast("int")).join(ranked, "rank").select("slot", F.col("pos").cast("bigint").alias("pos"), "node_id")


def identity_conflict(a: Column, b: Column, address_a: Column, address_b: Column) -> Column:
    """Whether two records of one node differ in address, or in a failure domain that both name."""
    return (address_a != address_b) | F.exists(F.map_keys(a), lambda k: F.coalesce(F.try_element_at(a, k) != F.try_element_at(b, k), F.lit(False)))


def violations(replicas: DataFrame, factor: int) -> DataFrame:
    """(slot, problem): chains with a node twice, without an active replica, or with more than one replica too many."""
    c = chains(replicas)
    ids = members("chain")
    problem = first_reason((F.size(ids) != F.size(F.array_distinct(ids)), "duplicate_node"), (F.size(members("chain", "active")) == 0, "no_active"), (F.size("chain") > factor + 1, "too_long"))
    return c.select("slot", problem.alias("problem")).where("problem is not null")


def change_shape(now: Column, wanted: Column) -> Column:
    """How a wanted chain differs: same, prefix, append, replace, disjoint or other."""
    gone, new = F.array_except(now, wanted), F.array_except(wanted, now)
    kept = F.filter(now, lambda x: F.array_contains(wanted, x)) == F.filter(wanted, lambda x: F.array_contains(now, x))
    return first_reason(
        (now == wanted, "same"), (F.slice(wanted, 1, F.size(now)) == now, "prefix"), ((F.size(new) == 1) & (F.size(gone) == 0) & kept, "append"),
        ((F.size(new) == 1) & (F.size(gone) == 1) & kept, "replace"), (~F.arrays_overlap(now, wanted), "disjoint"), (F.lit(True), "other"),
    )


def budgeted(changes: DataFrame, budget: int, unlimited: bool) -> DataFrame:
    """The first ``budget`` changes, fewest replicas and then slot first; a budget of 0 or less means all (append) or none (rebalance)."""
    if budget <= 0:
        return changes if unlimited else changes.where("false")
    return changes.orderBy("replicas", "slot").limit(budget)


def recovery(reported: DataFrame, assigned: DataFrame) -> DataFrame:
    """(node_id, slot, action, source) for reported replicas: drop what is not assigned, resume what can go on, else recover.

    A tail or single replica resumes if it has data, was active and has the
    same tail (none named: any); others recover from predecessor or successor.
    """
    j = reported.join(assigned.select("node_id", "slot", "role", "predecessor", "successor", F.col("tail").alias("now_tail")), ["node_id", "slot"], "left")
    goes_on = F.col("role").isin("tail", "single") & F.col("has_data") & (F.col("last_state") == "active") & ((F.coalesce("tail", F.lit("")) == "") | (F.col("tail") == F.col("now_tail")))
    action = F.when(F.col("role").isNull(), "drop").when(F.coalesce(goes_on, F.lit(False)), "resume").otherwise("recover")
    return j.select("node_id", "slot", action.alias("action"), F.when(action == "recover", F.coalesce("predecessor", "successor")).alias("source"))


def outbox_after(outbox: DataFrame, acknowledged: DataFrame, changed: DataFrame, planned: DataFrame) -> DataFrame:
    """Entries that are neither acknowledged nor of a changed slot, and those that the plan adds, to be sent by slot, kind, node and id."""
    return outbox.join(acknowledged.select("id"), "id", "left_anti").join(changed.select("slot"), "slot", "left_anti").unionByName(planned)


def report_outcome(reports: DataFrame, pending: DataFrame) -> DataFrame:
    """(report_id, outcome): a report fits the pending work of its slot, or the first thing that differs."""
    p = pending.select("slot", *[F.col(c).alias(f"p_{c}") for c in ("kind", "node_id", "command_id", "version")])
    outcome = first_reason(
        (F.col("p_kind").isNull(), "no_pending"), (F.col("kind") != F.col("p_kind"), "wrong_kind"), (F.col("node_id") != F.col("p_node_id"), "wrong_node"),
        (F.col("command_id") != F.col("p_command_id"), "wrong_command"), (F.col("version") != F.col("p_version"), "wrong_version"),
    )
    return reports.join(p, "slot", "left").select("report_id", F.coalesce(outcome, F.lit("accepted")).alias("outcome"))


def command_outcome(commands: DataFrame) -> DataFrame:
    """(index, outcome): the first command of an id is new, one with the same payload a cached duplicate, another a conflict."""
    first = F.first("payload").over(W.partitionBy("id").orderBy("index"))
    rank = F.row_number().over(W.partitionBy("id").orderBy("index"))
    return commands.select("index", F.when(rank == 1, "new").when(F.col("payload") == first, "duplicate").otherwise("conflict").alias("outcome"))


def slot_versions(changes: DataFrame) -> DataFrame:
    """(slot, version): one for each reconfiguration that changed the slot; progress changes none."""
    return changes.where(F.col("kind").isin("bootstrap", "reconfigure")).groupBy("slot").agg(F.count("*").alias("version"))


def leases(requests: DataFrame) -> DataFrame:
    """Adds ``epoch``: it rises by one whenever another holder takes over, in order of ``seq``; one lease, so one short log."""
    w = W.partitionBy("lease").orderBy("seq")
    took = F.coalesce(F.lag("holder").over(w) != F.col("holder"), F.lit(True)).cast("bigint")
    return requests.withColumn("took", took).withColumn("epoch", F.sum("took").over(w)).drop("took")


def epoch_fence(messages: DataFrame) -> DataFrame:
    """Adds ``fence``: a message of a lower epoch than one before it is rejected, the same is ignored, a higher one is stored."""
    top = F.coalesce(F.max("epoch").over(W.partitionBy("node_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return messages.withColumn("fence", F.when(F.col("epoch") == 0, "ignored").when(F.col("epoch") < top, "rejected").when(F.col("epoch") == top, "ignored").otherwise("stored"))


# --- liveness -----------------------------------------------------------------------------------


def target_state(age_s: Column, suspect_s: float, dead_s: float) -> Column:
    """Liveness by the age of a heartbeat; thresholds themselves count, no age is healthy."""
    return F.when(age_s <= 0, "healthy").when(age_s >= dead_s, "dead").when(age_s >= suspect_s, "suspect").otherwise("healthy")


def flaps(beats: DataFrame, window_s: int, most: int = 3) -> DataFrame:
    """Transitions into suspect, with how many the node had in the window up to each (both ends included), and whether it flaps."""
    turned = beats.withColumn("before", F.lag("state").over(W.partitionBy("node_id").orderBy("seq"))).where((F.col("state") == "suspect") & (F.coalesce("before", F.lit("")) != "suspect"))
    us = F.unix_micros(F.col("at").cast("timestamp"))
    w = W.partitionBy("node_id").orderBy("us").rangeBetween(-window_s * 1_000_000, 0)
    return turned.withColumn("us", us).withColumn("flaps", F.count("*").over(w)).select("node_id", "seq", "at", "flaps", (F.col("flaps") >= most).alias("flapping"))


def merged_liveness(durable: DataFrame, fresh: DataFrame) -> DataFrame:
    """(node_id, state, updated): the newer of two records, but a node recorded as dead stays dead."""
    d = durable.select("node_id", F.col("state").alias("d_state"), F.col("updated").alias("d_at"))
    f = fresh.select("node_id", F.col("state").alias("f_state"), F.col("updated").alias("f_at"))
    keep = F.col("f_at").isNull() | (F.col("d_state") == "dead") | (F.col("d_at") >= F.col("f_at"))
    pick = lambda c: F.when(F.coalesce(keep, F.lit(False)), F.col(f"d_{c}")).otherwise(F.col(f"f_{c}"))
    return d.join(f, "node_id", "full_outer").select("node_id", pick("state").alias("state"), pick("at").alias("updated"))


def node_fold(beats: DataFrame) -> DataFrame:
    """(node_id, beats, last_seen, dead, ready): heartbeats folded by node; dead is final, the first beat alive makes ready."""
    died = F.min(F.when(F.col("state") == "dead", F.col("seq")))
    g = beats.groupBy("node_id").agg(F.count("*").alias("beats"), F.max("seq").alias("last_seen"), died.alias("died"), F.min(F.when(F.col("state") != "dead", F.col("seq"))).alias("alive"))
    return g.select("node_id", "beats", "last_seen", F.col("died").isNotNull().alias("dead"), (F.col("alive").isNotNull() & F.col("died").isNull()).alias("ready"))


# Which transitions of a replica's lifecycle change it, and which repeat what was done
LIFECYCLE = {("activate", "catching_up"): "active", ("activate", "active"): "active", ("leave", "active"): "leaving", ("leave", "leaving"): "leaving", ("leave", "removed"): "removed", ("remove", "leaving"): "removed", ("resume", "recovered"): "active", ("recover", "recovered"): "active", ("drop", "recovered"): "removed"}


def lifecycle(steps: DataFrame) -> DataFrame:
    """Adds ``next``: the state that a step leads to from the current one; null if it may not be taken."""
    table = F.create_map(*[x for (step, state), after in LIFECYCLE.items() for x in (F.lit(f"{step}/{state}"), F.lit(after))])
    return steps.withColumn("next", F.try_element_at(table, F.concat_ws("/", "step", "state")))
