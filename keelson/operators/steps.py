"""Reconfiguration steps, progress and commands as relations over chains held as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.functions.conditions import first_reason


def without(a: Column, *gone: Column) -> Column:
    """An array in order without some members."""
    return F.filter(a, lambda x: ~F.coalesce(x.isin(*gone), F.lit(False)))


def one_more(now: Column, wanted: Column) -> Column:
    """The only member that ``now`` has and ``wanted`` has not; null if there is none, or more than one."""
    extra = F.array_except(now, wanted)
    return F.when(F.size(extra) == 1, extra[0])


def progress_outcome(events: DataFrame, replicas: DataFrame, dead: DataFrame, slots: int) -> DataFrame:
    """(event_id, outcome, next) of events (event_id, kind, slot, node_id): why one is refused, or the replica's next state.

    ``became_active`` needs a joining replica and makes it active; ``removed``
    needs a leaving one, or a dead node, and takes it out of the chain.
    """
    known = replicas.select("slot", "node_id", "state")
    e = events.join(known, ["slot", "node_id"], "left").join(dead.select("node_id", F.lit(True).alias("dead")), "node_id", "left")
    active, gone = F.col("kind") == "became_active", F.col("kind") == "removed"
    outcome = first_reason(
        (~(active | gone), "unsupported_event"),
        ((F.col("slot") < 0) | (F.col("slot") >= slots), "invalid_slot"),
        (F.col("node_id") == "", "empty_node"),
        (F.col("state").isNull(), "not_in_chain"),
        (active & (F.col("state") != "joining"), "not_joining"),
        (gone & (F.col("state") != "leaving") & ~F.coalesce("dead", F.lit(False)), "not_removable"),
    )
    next_ = F.when(outcome.isNull(), F.when(active, "active").otherwise("gone"))
    return e.select("event_id", F.coalesce(outcome, F.lit("applied")).alias("outcome"), next_.alias("next"))


def drain_finalization(chains: DataFrame, draining: DataFrame, factor: int) -> DataFrame:
    """(slot, kept, leaving) of the chains whose draining members can leave.

    None may be joining, some draining member must be active, and those that
    stay must be as many as there should be; they come first, in order.
    ``chains`` has slot, pos, node_id and state.
    """
    r = chains.join(draining.select("node_id", F.lit(True).alias("draining")), "node_id", "left")
    mine = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "node_id")))), lambda x: x["node_id"])
    active = F.col("state") == "active"
    drains = F.coalesce("draining", F.lit(False))
    c = r.groupBy("slot").agg(mine(active & ~drains).alias("kept"), mine(active & drains).alias("leaving"), F.bool_or(F.col("state") == "joining").alias("joining"))
    return c.where(~F.col("joining") & (F.size("leaving") > 0) & (F.size("kept") == factor)).select("slot", "kept", "leaving")


def join_finalization(chains: DataFrame, factor: int) -> DataFrame:
    """(slot, leaving) of chains (slot, actives, pending, draining, wanted) that have one active replica too many after a join.

    The one that leaves is the only one not wanted; the newest must be wanted,
    and the others stand in the wanted order.
    """
    c = chains.where(~F.col("pending") & ~F.col("draining") & (F.size("actives") == factor + 1))
    c = c.withColumn("leaving", one_more(F.col("actives"), F.col("wanted"))).withColumn("new", F.element_at("actives", -1)).where("leaving is not null")
    fits = (F.col("new") != F.col("leaving")) & F.array_contains("wanted", F.col("new")) & same_order_after_join(F.col("actives"), F.col("leaving"), F.col("new"), F.col("wanted"))
    return c.where(fits).select("slot", "leaving")


def same_order_after_join(now: Column, leaving: Column, new: Column, wanted: Column) -> Column:
    """Whether the members that stay have the wanted order, the one that leaves and the new one aside."""
    return without(now, leaving, new) == without(wanted, new)


def join_append(chains: DataFrame, factor: int) -> DataFrame:
    """(slot, outcome, added, removed) of full chains (slot, actives, pending, draining, dead, wanted) that differ from what is wanted by one member.

    ``append`` if the others keep their order; ``disjoint`` if no member is
    wanted, which is an error. Other chains are left as they are, without a row.
    """
    c = chains.where(~F.col("pending") & ~F.col("draining") & ~F.col("dead") & (F.size("actives") == factor) & (F.size("wanted") == factor))
    c = c.withColumn("added", one_more(F.col("wanted"), F.col("actives"))).withColumn("removed", one_more(F.col("actives"), F.col("wanted")))
    one = F.col("added").isNotNull() & F.col("removed").isNotNull()
    apart = ~F.arrays_overlap("actives", "wanted")
    order = without(F.col("actives"), F.col("removed")) == without(F.col("wanted"), F.col("added"))
    outcome = F.when(one & order, "append").when(~one & apart, "disjoint")
    return c.withColumn("outcome", outcome).where("outcome is not null").select("slot", "outcome", *[F.when(F.col("outcome") == "append", F.col(x)).alias(x) for x in ("added", "removed")])


def missing_append(chains: DataFrame, usable: DataFrame, factor: int) -> DataFrame:
    """(slot, node_id, replaced) to append to short chains (slot, members, pending, wanted) that are a prefix of what is wanted.

    The next wanted node must be usable (alive, ready, not draining) and new to the chain.
    """
    n = F.size("members")
    c = chains.where(~F.col("pending") & (n < factor) & (F.size("wanted") > n)).where(F.col("members") == F.slice("wanted", F.lit(1), n))
    c = c.select("slot", "members", F.element_at("wanted", n + 1).alias("node_id"), F.when(F.size("wanted") >= factor, F.col("wanted")[factor - 1]).otherwise("").alias("replaced"))
    return c.where(~F.array_contains("members", F.col("node_id"))).join(usable.select("node_id"), "node_id", "left_semi").select("slot", "node_id", "replaced")


def distinct_kinds(steps: Column) -> Column:
    """Kinds of an array of steps, the first of each kept."""
    return F.array_distinct(F.transform(steps, lambda s: s["kind"]))


def pending_after(pending: DataFrame, plans: DataFrame, progressed: DataFrame) -> DataFrame:
    """(slot, node_id, kind) of pending work (slot, node_id, kind) after plans (slot, steps) and progress (slot).

    A planned slot loses what it had; it gets work if its steps are of one
    kind: ``ready`` for the first appended node, ``removed`` for the first one
    that leaves. Slots that progressed lose theirs.
    """
    kinds = distinct_kinds(F.col("steps"))
    kind = F.when(F.size(kinds) == 1, F.when(kinds[0] == "append_tail", "ready").when(kinds[0] == "mark_leaving", "removed"))
    new = plans.select("slot", F.col("steps")[0]["node_id"].alias("node_id"), kind.alias("kind")).where("kind is not null and node_id <> ''")
    kept = pending.join(plans.select("slot"), "slot", "left_anti").select("slot", "node_id", "kind")
    return kept.unionByName(new).join(progressed.select("slot"), "slot", "left_anti")


def payload_problem(commands: DataFrame, kinds: list[str]) -> DataFrame:
    """(id, problem) of commands (id, kind, payloads): exactly the payload of its kind must be there."""
    known = F.array(*[F.lit(k) for k in kinds])
    problem = first_reason((~F.array_contains(known, F.col("kind")), "unsupported_kind"), (~F.array_contains("payloads", F.col("kind")), "no_payload"), (F.size("payloads") > 1, "other_payload"))
    return commands.select("id", problem.alias("problem"))


def completed_match(records: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked_id, matches) of asked (asked_id, slot, node_id, kind, version) by a slot's completed progress.

    A record of the same node, kind and version matches; so does, whatever its
    version, the only record of that node and kind.
    """
    r = records.select("slot", "node_id", "kind", F.col("version").alias("done"))
    j = asked.join(r, ["slot", "node_id", "kind"], "left")
    got = j.groupBy("asked_id").agg(F.count("done").alias("n"), F.coalesce(F.bool_or(F.col("done") == F.col("version")), F.lit(False)).alias("same"))
    return got.select("asked_id", (F.col("same") | (F.col("n") == 1)).alias("matches"))


def commit_outcome(messages: DataFrame, cursors: DataFrame, prepared: DataFrame, retained: DataFrame) -> DataFrame:
    """(slot, sequence, outcome) of commit messages (slot, sequence, source) at replicas.

    Past ones are ignored if the retained commit has the same source, conflict
    if another, and are too old if none is retained. The next one is applied if
    it is prepared; any later or unprepared one is buffered.
    ``cursors`` has slot and committed, ``prepared`` slot and sequence,
    ``retained`` slot, sequence and source.
    """
    m = messages.join(cursors, "slot").join(prepared.select("slot", "sequence", F.lit(True).alias("ready")).distinct(), ["slot", "sequence"], "left")
    m = m.join(retained.select("slot", "sequence", F.col("source").alias("was")), ["slot", "sequence"], "left")
    past = F.when(F.col("was").isNull(), "too_old").when(F.col("was") == F.col("source"), "ignore").otherwise("conflict")
    now = F.when((F.col("sequence") > F.col("committed") + 1) | F.col("ready").isNull(), "buffer").otherwise("apply")
    return m.select("slot", "sequence", F.when(F.col("sequence") <= F.col("committed"), past).otherwise(now).alias("outcome"))


def buffered_commits(messages: DataFrame, cursors: DataFrame, limit: int) -> DataFrame:
    """(slot, sequence, arrival, outcome) of future commits (slot, sequence, source, arrival): kept, repeated, conflicting or beyond the limit.

    The first message of a sequence takes a place in its slot's buffer while
    fewer than ``limit`` are taken; later ones are compared with it. A message
    that found no place leaves no trace.
    """
    future = messages.join(cursors, "slot").where(F.col("sequence") > F.col("committed") + 1)
    of = W.partitionBy("slot", "sequence").orderBy("arrival")
    f = future.withColumn("nth", F.row_number().over(of)).withColumn("held", F.first("source").over(of)).withColumn("since", F.first("arrival").over(of))
    firsts = f.where("nth = 1").select("slot", "sequence", "arrival")
    # only the first of ``limit`` sequences have a place, so a slot's window is cut before it is shuffled
    placed = firsts.withColumn("place", F.row_number().over(W.partitionBy("slot").orderBy("arrival"))).where(F.col("place") <= limit).select("slot", "sequence", F.lit(True).alias("placed"))
    j = f.join(placed, ["slot", "sequence"], "left")
    outcome = F.when(F.col("placed").isNull(), "backpressure").when(F.col("nth") == 1, "buffer").when(F.col("held") == F.col("source"), "ignore").otherwise("conflict")
    return j.select("slot", "sequence", "arrival", outcome.alias("outcome"))


def applied_commit(slots: DataFrame, dirty: DataFrame) -> DataFrame:
    """(slot, committed, dirty_keys) after each slot of ``slots`` (slot, committed) has committed up to there: what was dirty up to it is clean.

    ``dirty`` has slot, key and sequence.
    """
    left = dirty.join(slots, "slot").where("sequence > committed").groupBy("slot").agg(F.count_distinct("key").alias("dirty_keys"))
    return slots.join(left, "slot", "left").select("slot", "committed", F.coalesce("dirty_keys", F.lit(0)).alias("dirty_keys"))


def liveness_evaluation(nodes: DataFrame, suspect_s: float, dead_s: float, flap_threshold: int, pending: bool) -> DataFrame:
    """(node_id, next, evicted, action) of nodes (node_id, state, age_s, flaps, dead_action_fired, known_dead).

    The target follows from the age of the last heartbeat. A node that becomes
    suspect as often as ``flap_threshold`` within the window, this time
    included, is dead. A dead node whose action has not fired has it deferred
    while work is pending, settled if it is known to be dead, else it is marked
    dead now.
    """
    target = F.when(F.col("age_s") >= dead_s, "dead").when(F.col("age_s") >= suspect_s, "suspect").otherwise("healthy")
    moves = target != F.col("state")
    evicted = moves & (target == "suspect") & (F.col("flaps") + 1 >= flap_threshold)
    n = nodes.withColumn("evicted", evicted).withColumn("next", F.when(evicted, "dead").otherwise(target))
    action = F.when((F.col("next") == "dead") & ~F.col("dead_action_fired"), F.when(F.lit(pending), "deferred").when(F.col("known_dead"), "settled").otherwise("mark_dead"))
    return n.select("node_id", "next", "evicted", action.alias("action"))


def acknowledged(entries: DataFrame, commands: DataFrame) -> DataFrame:
    """(command_id, found, changes) of acknowledgements (command_id, entry_id): one of which no entry is there changes nothing, not even the version."""
    j = commands.join(entries.select("entry_id", F.lit(1).alias("there")), "entry_id", "left").groupBy("command_id").agg(F.count("there").alias("found"))
    return j.select("command_id", "found", (F.col("found") > 0).alias("changes"))


def replay_problems(log: DataFrame) -> DataFrame:
    """(id, index) of log records (index, id) that repeat an earlier record's id: a log that has one cannot be replayed."""
    first = log.groupBy("id").agg(F.min("index").alias("first"))
    return log.join(first, "id").where("index > first").select("id", "index")
