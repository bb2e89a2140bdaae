"""Replay of an operation log into ordered commits, object versions and state, and reads of that state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Arrivals, or sequences, of a bucket: what a window by slot sorts at most. A slot may hold a third of the log.
BUCKET = 65_536


def _with_earlier(rows: DataFrame, by: list[str], fold, **totals: Column) -> DataFrame:
    """``rows``, which have a bucket, with ``fold`` (F.sum or F.max) of the totals of their group's earlier buckets, as before_ and the name.

    Buckets are summed up by a partial aggregate, so only one row a bucket
    meets in a group's window, however many rows the group has.
    """
    per = rows.groupBy(*by, "bucket").agg(*[c.alias(n) for n, c in totals.items()])
    earlier = W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    return rows.join(per.select(*by, "bucket", *[fold(n).over(earlier).alias(f"before_{n}") for n in totals]), [*by, "bucket"])


def numbered(rows: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """Adds each row's number in its group by a whole-number ``order``: its place in its bucket, and the rows of earlier buckets."""
    held = _with_earlier(rows.withColumn("bucket", F.floor(F.col(order) / BUCKET)), by, F.sum, n=F.count("*"))
    place = F.row_number().over(W.partitionBy(*by, "bucket").orderBy(order))
    return held.withColumn(name, (F.coalesce("before_n", F.lit(0)) + place).cast("bigint")).drop("bucket", "before_n")


def _by_key() -> W:
    return W.partitionBy("slot", "key").orderBy("arrival")


def effective(ops: DataFrame) -> DataFrame:
    """Marks each operation: a delete takes effect only on a key that exists, that is, whose last operation was a put."""
    return ops.withColumn("applied", F.coalesce((F.col("kind") == "put") | (F.lag("kind").over(_by_key()) == "put"), F.lit(False)))


def replay(ops: DataFrame) -> DataFrame:
    """Effective operations with their slot's sequence and the object metadata that they write.

    A delete ends an object's lifetime; the next put begins at version 1 with a
    new creation time. Suppressed deletes take no sequence. Versions need a
    window by key; sequences are numbered by buckets of arrivals, so no slot is
    one task's.
    """
    log = effective(ops).where("applied").drop("applied")
    ended = F.coalesce(F.sum((F.col("kind") == "delete").cast("bigint")).over(_by_key().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    log = log.withColumn("lifetime", ended)
    in_life = W.partitionBy("slot", "key", "lifetime").orderBy("arrival")
    log = log.withColumn("version", F.row_number().over(in_life).cast("bigint")).withColumn("created_at", F.first("at").over(in_life))
    return numbered(log, ["slot"], "arrival", "sequence").withColumnRenamed("at", "updated_at")


_OBJECT = ["kind", "value", "version", "created_at", "updated_at", "sequence"]


def latest(log: DataFrame) -> DataFrame:
    """The last operation of each key, deletes included; a partial aggregate, so a hot key is not gathered."""
    last = log.groupBy("slot", "key").agg(F.max_by(F.struct(*_OBJECT), "sequence").alias("o"))
    return last.select("slot", "key", "o.*")


def state(log: DataFrame) -> DataFrame:
    """Committed objects: the last operation of each key, where it is a put."""
    return latest(log).where("kind = 'put'").drop("kind")


def point_get(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """(slot, key, found, value, version) for asked (slot, key); the slot predicate prunes partitions of stored state."""
    there = objects.select("slot", "key", "value", "version", F.lit(True).alias("there"))
    return keys.join(there, ["slot", "key"], "left").select("slot", "key", F.coalesce("there", F.lit(False)).alias("found"), "value", "version")


def read_as_of(objects: DataFrame, dirty: DataFrame, tails: DataFrame) -> DataFrame:
    """Linearizable reads of all keys at a replica: its newest dirty operation that the tail has committed, else its object.

    ``objects`` (with deletes, as from ``latest``) is what the replica has
    committed, ``dirty`` what it has only prepared, ``tails`` the committed
    sequence of each slot's tail. A committed delete hides the object.
    """
    seen = dirty.join(tails, "slot").where("sequence <= tail_sequence")
    return overlay(objects, latest(seen.select("slot", "key", *_OBJECT))).where("kind = 'put'").drop("kind")


def overlay(base: DataFrame, over: DataFrame) -> DataFrame:
    """``base`` with the keys of ``over`` put in their place; a delete in ``over`` masks the base's object."""
    return base.join(over, ["slot", "key"], "left_anti").unionByName(over)


def contiguous_prefix(entries: DataFrame, by: list[str], sequence: str = "sequence") -> DataFrame:
    """(by, prefix): the largest n such that 1 to n are all there; 0 if 1 is missing. Repeats count once."""
    distinct = entries.select(*by, sequence).distinct()
    return numbered(distinct, by, sequence, "rank").groupBy(*by).agg(F.coalesce(F.max(F.when(F.col(sequence) == F.col("rank"), F.col(sequence))), F.lit(0)).cast("bigint").alias("prefix"))


def gaps(entries: DataFrame, by: list[str], sequence: str = "sequence") -> DataFrame:
    """(by, first_missing, last_missing): the runs of sequences that are missing before the highest."""
    distinct = entries.select(*by, sequence).distinct().withColumn("bucket", F.floor(F.col(sequence) / BUCKET))
    held = _with_earlier(distinct, by, F.max, last=F.max(sequence))
    before = F.coalesce(F.lag(sequence).over(W.partitionBy(*by, "bucket").orderBy(sequence)), "before_last", F.lit(0))
    return held.withColumn("before", before).where(F.col(sequence) > F.col("before") + 1).select(*by, (F.col("before") + 1).cast("bigint").alias("first_missing"), (F.col(sequence) - 1).cast("bigint").alias("last_missing"))


def high_water(entries: DataFrame, by: list[str], order: str, sequence: str = "sequence", bucket: Column | None = None) -> DataFrame:
    """Adds the running maximum of the sequence in order of arrival; ``bucket`` tells buckets of another order that is no whole number."""
    held = _with_earlier(entries.withColumn("bucket", F.floor(F.col(order) / BUCKET) if bucket is None else bucket), by, F.max, top=F.max(sequence))
    here = F.max(sequence).over(W.partitionBy(*by, "bucket").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return held.withColumn("high_water", F.greatest(here, "before_top")).drop("bucket", "before_top")


def last_n(rows: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each group, oldest first by ``order``: bounded histories and rings.

    Spark limits each group before the shuffle, so a hot one sends ``n`` rows a task.
    """
    return rows.withColumn("back", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("back") <= n).drop("back")


def coalesced(records: DataFrame, by: list[str], sequence: str = "sequence") -> DataFrame:
    """One record a group, with the highest sequence and how many it stands for."""
    return records.groupBy(*by).agg(F.max(sequence).alias(sequence), F.count("*").alias("records"))


def replay_journal(journal: DataFrame, assignments: DataFrame, materialized: DataFrame) -> DataFrame:
    """Recovered cursors (slot, prepared, committed, confirmed, backlog) from journal records of the current chain version.

    A tail has committed all of its contiguous prepared prefix; others what
    watermarks, head ranges and old commit records say. The backlog is what is
    committed and not yet in the state. Slots without records have cursors 0.
    """
    here = journal.join(assignments, ["slot", "chain_version"])
    kind = lambda *k: F.max(F.when(F.col("type").isin(*k), F.col("sequence")))
    cursors = here.groupBy("slot").agg(kind("prepare", "commit").alias("prepared"), kind("commit_watermark", "head_commit_range", "commit").alias("marked"), kind("upstream_confirm").alias("confirmed"))
    prefix = contiguous_prefix(here.where(F.col("type").isin("prepare", "commit")), ["slot"])
    out = assignments.join(cursors, "slot", "left").join(prefix, "slot", "left").join(materialized, "slot", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    committed = F.when(F.col("role").isin("tail", "single"), zero("prefix")).otherwise(zero("marked"))
    return out.select("slot", "role", zero("prepared").alias("prepared"), committed.alias("committed"), zero("confirmed").alias("confirmed"), F.greatest(committed - zero("materialized"), F.lit(0)).cast("bigint").alias("backlog"))


def to_materialize(commits: DataFrame, materialized: DataFrame) -> DataFrame:
    """Commits with what becomes of them: ``skip`` what is in the state, ``apply`` what follows without a gap, else ``gap``."""
    rows = commits.join(materialized, "slot", "left").withColumn("materialized", F.coalesce("materialized", F.lit(0)))
    old = rows.where("sequence <= materialized").select("slot", "sequence", F.lit("skip").alias("action"))
    new = numbered(rows.where("sequence > materialized"), ["slot"], "sequence", "place")
    return old.unionByName(new.select("slot", "sequence", F.when(F.col("sequence") == F.col("materialized") + F.col("place"), "apply").otherwise("gap").alias("action")))


def round_robin(requests: DataFrame, by: str, order: str, n: Column) -> DataFrame:
    """Adds which of ``n`` read replicas each request starts at, in turn within a slot."""
    return numbered(requests, [by], order, "turn").withColumn("replica", ((F.col("turn") - 1) % n).cast("bigint")).drop("turn")


def fair_batches(pending: DataFrame, most_ops: int, most_bytes: int, size: str = "bytes", slots: int | None = None) -> DataFrame:
    """Numbers pending operations into batches of one shard: round-robin over slots, capped by operations and bytes.

    An operation goes to the batch in which the running count and the running
    bytes place it, so caps hold up to the operation that crosses a byte cap.
    """
    turn = numbered(pending, ["shard", "slot"], "arrival", "turn").withColumn("bucket", F.floor(F.col("turn") / 1024))
    held = _with_earlier(turn, ["shard"], F.sum, n=F.count("*"), bytes_=F.sum(size))
    order = W.partitionBy("shard", "bucket").orderBy("turn", "slot", "arrival")
    at = F.coalesce("before_n", F.lit(0)) + F.row_number().over(order) - 1
    before = F.coalesce("before_bytes_", F.lit(0)) + F.coalesce(F.sum(size).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return held.withColumn("batch", F.greatest(F.floor(at / most_ops), F.floor(before / most_bytes)).cast("bigint")).drop("bucket", "before_n", "before_bytes_")


def credits(slots: DataFrame, limit: int = 64, prepare_window: int = 32, commit_window: int = 16) -> DataFrame:
    """Adds the credit a replica grants by kind, from its buffered counts and gaps; a gap grants none."""
    free = F.greatest(limit - F.col("buffered"), F.lit(0))
    grant = lambda most: F.when(F.col("has_gap"), 0).otherwise(F.least(free, F.lit(most))).cast("bigint")
    return slots.withColumn("forward_credit", grant(prepare_window)).withColumn("commit_credit", grant(commit_window)).withColumn("advance_credit", grant(1))
