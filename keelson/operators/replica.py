"""What a replica accepts and keeps when its peers change: sources of messages, retargeting, snapshots, transitions; and the outbox as a fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.functions.conditions import first_reason
from keelson.operators.control import lifecycle
from keelson.operators.steps import completed_match


def _held(messages: DataFrame, held: DataFrame, replicas: DataFrame, stores: list[str]) -> DataFrame:
    """Messages beside their slot's record and what each store holds of the same sequence; one aggregate for all stores."""
    of = lambda s: F.min(F.when(F.col("store") == s, F.struct("from_node", "version"))).alias(s)
    kept = held.where(F.col("store").isin(stores)).groupBy("slot", "sequence").agg(*[of(s) for s in stores])
    return messages.join(kept, ["slot", "sequence"], "left").join(replicas, "slot")


def _differs(node: Column, version: Column, also: Column) -> Column:
    wrong = first_reason(((node == "") | node.isNull() | (node != F.col("from_node")), "wrong_node"), ((version != F.col("version")) & ~also, "wrong_version"))
    return F.coalesce(wrong, F.lit("accepted")).alias("outcome")


def _now(peer: str) -> Column:
    return (F.col(peer) == F.col("from_node")) & (F.col("chain_version") == F.col("version"))


def forward_source(messages: DataFrame, held: DataFrame, replicas: DataFrame) -> DataFrame:
    """(slot, sequence, from_node, version, outcome) of forwards: the source must be that of the message held for the sequence, else the predecessor.

    A message is held as staged, buffered or recent, in this order. Another
    chain version passes only if source and version are those of today.
    ``held`` has slot, sequence, store, from_node and version, ``replicas``
    slot, predecessor, successor and chain_version.
    """
    m = _held(messages, held, replicas, ["staged", "buffered", "recent"])
    first = F.coalesce("staged", "buffered", "recent", F.struct(F.col("predecessor").alias("from_node"), F.col("chain_version").alias("version")))
    return m.select("slot", "sequence", "from_node", "version", _differs(first["from_node"], first["version"], _now("predecessor")))


def commit_source(messages: DataFrame, held: DataFrame, replicas: DataFrame) -> DataFrame:
    """The same of commits: the source expected for the sequence goes before one held, that before the successor.

    An expected source without a node counts as none. A staged forward gives
    the version only. Only with an expected source does today's version pass.
    """
    m = _held(messages, held, replicas, ["expected", "buffered", "recent", "staged"])
    asked = F.when(F.col("expected.from_node") != "", F.col("expected"))
    node = F.coalesce(asked["from_node"], "buffered.from_node", "recent.from_node", "successor")
    version = F.coalesce(asked["version"], "buffered.version", "recent.version", "staged.version", "chain_version")
    return m.select("slot", "sequence", "from_node", "version", _differs(node, version, asked.isNotNull() & _now("successor")))


def advance_source(messages: DataFrame, replicas: DataFrame) -> DataFrame:
    """The same of cumulative advances: only today's successor and version pass."""
    return messages.join(replicas, "slot").select("slot", "sequence", "from_node", "version", _differs(F.col("successor"), F.col("chain_version"), F.lit(False)))


def retarget_forwards(held: DataFrame, replicas: DataFrame) -> DataFrame:
    """Staged and buffered forwards left after the slot got a new assignment: those of the predecessor get its version, committed ones go."""
    h = held.where("store in ('staged', 'buffered')").join(replicas, "slot").where("sequence > committed")
    mine = (F.col("predecessor") != "") & (F.col("from_node") == F.col("predecessor"))
    return h.select("slot", "sequence", "store", "from_node", F.when(mine, F.col("chain_version")).otherwise(F.col("version")).alias("version"))


def retarget_commits(held: DataFrame, replicas: DataFrame) -> DataFrame:
    """Expected commit sources left after the same: the successor in its version; none if there is no successor."""
    h = held.where("store = 'expected'").join(replicas, "slot").where("sequence > committed and successor <> ''")
    return h.select("slot", "sequence", F.col("successor").alias("from_node"), F.col("chain_version").alias("version"))


def updated_peers(replicas: DataFrame, wanted: DataFrame) -> DataFrame:
    """(slot, confirmed, token, forwards, commits) after an assignment: cursors, and whether forwards and commits are retargeted.

    A new predecessor has confirmed what is committed. A replica left without
    successor takes all it has prepared for committed by the tail.
    ``wanted`` has slot, new_predecessor, new_successor and new_version.
    """
    c = replicas.join(wanted, "slot")
    version = F.col("new_version") != F.col("chain_version")
    before, after = F.col("new_predecessor") != F.col("predecessor"), F.col("new_successor") != F.col("successor")
    last = (version | after) & (F.col("new_successor") == "")
    return c.select(
        "slot", F.when(before, F.col("committed")).otherwise(F.col("confirmed")).alias("confirmed"),
        F.when(last, F.greatest("prepared", "token")).otherwise(F.col("token")).alias("token"), (version | before).alias("forwards"), (version | after).alias("commits"),
    )


def rebased(slots: DataFrame, held: DataFrame) -> DataFrame:
    """(slot, committed, next_sequence, kept, dirty) of slots (slot, snapshot, next_sequence) that took a snapshot of a peer.

    All cursors are the snapshot's sequence, and what is pending, staged or
    buffered up to there goes; of the rest, pending and staged ones are dirty.
    """
    left = held.where("store in ('pending', 'staged', 'buffered')").join(slots.select("slot", "snapshot"), "slot").where("sequence > snapshot")
    n = left.groupBy("slot").agg(F.count("*").alias("kept"), F.count_if(F.col("store") != "buffered").alias("dirty"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return slots.join(n, "slot", "left").select("slot", F.col("snapshot").alias("committed"), F.greatest("next_sequence", F.col("snapshot") + 1).alias("next_sequence"), zero("kept"), zero("dirty"))


def gap_catchup(slots: DataFrame, held: DataFrame) -> DataFrame:
    """Rebased slots (as ``rebased`` has them) of those (slot, snapshot, committed, next_sequence) that wait for a missing message while their predecessor is ahead.

    A slot waits if messages are buffered and the next one is not among them.
    """
    buffered = held.where("store = 'buffered'").join(slots.select("slot", "next_sequence"), "slot").where("sequence >= next_sequence")
    waits = buffered.groupBy("slot").agg(F.min("sequence").alias("first"), F.first("next_sequence").alias("next")).where("first > next").select("slot")
    return rebased(slots.where("snapshot > committed").join(waits, "slot", "left_semi").select("slot", "snapshot", "next_sequence"), held)


def transition(steps: DataFrame) -> DataFrame:
    """Adds ``outcome`` to steps (step, state, same): the next state, or ``unknown``, ``unchanged`` or ``invalid``.

    Activation of an active replica changes nothing; so does recovery or
    resumption of an active one whose assignment is the same. A slot that is
    not there (null) can be recovered, and else is unknown.
    """
    state, step = F.col("state"), F.col("step")
    repeats = (state == "active") & ((step == "activate") | (step.isin("recover", "resume") & F.col("same")))
    outcome = F.when(state.isNull() & (step == "recover"), "active").when(state.isNull(), "unknown").when(repeats, "unchanged").otherwise(F.coalesce("next", F.lit("invalid")))
    return lifecycle(steps).withColumn("outcome", outcome).drop("next")


def registration(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(report_id, outcome) of registrations (report_id, node_id, address, domains): ``unchanged`` for a living node of the same address and domains, else ``reconfigure``.

    ``known`` has node_id, rpc_address, domains as a sorted array of entries, and dead.
    """
    k = known.select("node_id", "rpc_address", F.col("domains").alias("theirs"), "dead")
    same = (F.col("rpc_address") == F.col("address")) & (F.col("theirs") == F.col("domains")) & ~F.col("dead")
    return asked.join(k, "node_id", "left").select("report_id", F.when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("reconfigure").alias("outcome"))


def heartbeat_outcome(beats: DataFrame, known: DataFrame) -> DataFrame:
    """(node_id, outcome, turns_healthy, turns_ready) of nodes' heartbeats (node_id): unknown and dead ones are refused.

    An accepted one makes a suspect node healthy, and the first makes it ready.
    ``known`` has node_id, dead, state and ready.
    """
    b = beats.join(known, "node_id", "left")
    outcome = F.when(F.col("dead").isNull(), "unknown").when(F.col("dead"), "dead").otherwise("accepted")
    lives = F.coalesce(~F.col("dead"), F.lit(False))
    return b.select("node_id", outcome.alias("outcome"), (lives & F.coalesce(F.col("state") == "suspect", F.lit(False))).alias("turns_healthy"), (lives & ~F.coalesce("ready", F.lit(False))).alias("turns_ready"))


def recovery_entries(triage: DataFrame, versions: DataFrame, epoch: int) -> DataFrame:
    """Outbox entries (id, slot, node_id, kind, slot_version, source, epoch, failed) of triaged replicas (node_id, slot, action, source).

    One that is dropped has no version; one to be recovered without a source
    fails the report. ``versions`` has slot and slot_version.
    """
    t = triage.join(versions, "slot", "left")
    version = F.when(F.col("action") != "drop", F.col("slot_version"))
    failed = (F.col("action") == "recover") & F.col("source").isNull()
    return t.select(F.concat_ws("/", "action", "node_id", "slot").alias("id"), "slot", "node_id", F.col("action").alias("kind"), version.alias("slot_version"), "source", F.lit(epoch).alias("epoch"), failed.alias("failed"))


def rebuilt_outbox(stored: DataFrame, runtime: DataFrame, refreshes: DataFrame, epoch: int) -> DataFrame:
    """(id, slot, kind, node_id, epoch, place): stored entries of recovery kinds, then the runtime's and the peer refreshes', both of this epoch.

    ``place`` is the order within a slot by kind, node and id; a slot has a
    few entries, and slots are independent of each other.
    """
    kept = stored.where("kind in ('drop', 'resume', 'recover')").select("id", "slot", "kind", "node_id", "epoch")
    new = [df.select("id", "slot", "kind", "node_id", F.lit(epoch).cast("bigint").alias("epoch")) for df in (runtime, refreshes)]
    place = F.row_number().over(W.partitionBy("slot").orderBy("kind", "node_id", "id"))
    return kept.unionByName(new[0]).unionByName(new[1]).withColumn("place", place.cast("bigint"))


def outbox_fold(commands: DataFrame, entries: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Entries (id, index, slot) that are left after a log of commands (index, kind, slot).

    A later bootstrap clears all, a later plan or progress of a slot its
    entries, a later acknowledgement (index, id) its entry. The last of each
    decides, so the fold is three maxima and no state goes from row to row.
    """
    boot = commands.where("kind = 'bootstrap'").agg(F.max("index")).scalar()
    moved = commands.where("kind in ('reconfigure', 'progress')").groupBy("slot").agg(F.max("index").alias("moved"))
    done = acknowledged.groupBy("id").agg(F.max("index").alias("done"))
    left = entries.where(F.col("index") > F.coalesce(boot, F.lit(-1))).join(moved, "slot", "left").join(done, "id", "left")
    return left.where("index >= coalesce(moved, -1) and index >= coalesce(done, -1)").select("id", "index", "slot")


def progress_report(reports: DataFrame, pending: DataFrame, records: DataFrame) -> DataFrame:
    """(report_id, outcome) of ready and removed reports (report_id, slot, kind, node_id, command_id, slot_version, state).

    One that is not pending is a ``duplicate`` if the slot's completed
    progress has it, else ``unexpected``. Empty command ids match all. The
    replica must be joining (ready) or leaving (removed).
    """
    asked = reports.select(F.col("report_id").alias("asked_id"), "slot", "node_id", "kind", F.col("slot_version").alias("version"))
    done = completed_match(records, asked).select(F.col("asked_id").alias("report_id"), "matches")
    p = pending.select("slot", *[F.col(c).alias(f"p_{c}") for c in ("kind", "node_id", "command_id", "slot_version")])
    waits = F.coalesce((F.col("p_kind") == F.col("kind")) & (F.col("p_node_id") == F.col("node_id")), F.lit(False))
    other = (F.col("command_id") != "") & (F.col("p_command_id") != "") & (F.col("command_id") != F.col("p_command_id"))
    outcome = first_reason(
        (~waits & F.col("matches"), "duplicate"), (~waits, "unexpected"), (other, "wrong_command"), (F.col("slot_version") != F.col("p_slot_version"), "wrong_version"),
        (F.col("state") != F.when(F.col("kind") == "ready", "joining").otherwise("leaving"), "wrong_state"), (F.lit(True), "accepted"),
    )
    return reports.join(p, "slot", "left").join(done, "report_id").select("report_id", outcome.alias("outcome"))


def evaluated(commands: DataFrame, applied: DataFrame, runtimes: DataFrame) -> DataFrame:
    """(command_id, outcome, version) of commands (command_id, runtime, id, expected, payload, valid), each tried on its runtime's state, which stays as it is.

    An applied command's repetition gives the version it got then, with
    another payload a conflict; a new one raises the version if it expects the
    current one. ``applied`` has runtime, id, payload and version.
    """
    was = applied.select("runtime", "id", F.col("payload").alias("was"), F.col("version").alias("then"))
    c = commands.join(runtimes.select("runtime", F.col("version").alias("now")), "runtime").join(was, ["runtime", "id"], "left")
    outcome = first_reason(
        ((F.col("id") == "") | ~F.col("valid"), "invalid"), (F.col("was") == F.col("payload"), "duplicate"), (F.col("was").isNotNull(), "conflict"),
        (F.col("expected") != F.col("now"), "version_mismatch"), (F.lit(True), "applied"),
    )
    c = c.withColumn("outcome", outcome)
    return c.select("command_id", "outcome", F.when(F.col("outcome") == "duplicate", F.col("then")).when(F.col("outcome") == "applied", F.col("now") + 1).alias("version"))
