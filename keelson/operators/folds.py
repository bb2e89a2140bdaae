"""Folds whose every step needs the state that the last one left: conditional writes and data-driven intervals.

Rows are dealt by key and sorted in their partition, then stream through with
the current key's state only, so neither a long key nor a long partition is
ever held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPS: dict[str, Callable] = {"eq": lambda a, b: a == b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b}


def streamed(rows: DataFrame, by: list[str], order: list[str], start: Callable, step: Callable, schema: str, end: Callable | None = None) -> DataFrame:
    """Folds each group in order: ``step(state, row)`` gives the next state and rows out, ``end(state)`` the last rows."""
    names = [c.split()[0].strip("`") for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                now = tuple(getattr(row, c) for c in by)
                if now != key:
                    if end is not None and key is not None:
                        out += end(held)
                    key, held = now, start(row)
                held, made = step(held, row)
                out += made
            yield pd.DataFrame(out, columns=names)
        if end is not None and key is not None:
            yield pd.DataFrame(end(held), columns=names)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def _write(held: tuple, row) -> tuple[tuple, list[tuple]]:
    """One conditional write on (found, version, created, updated): applied, condition_failed or noop."""
    found, version, created, updated = held

    def meets(op, have, want) -> bool:
        return op is None or (found and op in OPS and OPS[op](have, want))

    if (row.want_exists is not None and row.want_exists != found) or not meets(row.version_op, version, row.want_version) or not meets(row.time_op, updated, row.want_time):
        return held, [(row.arrival, row.slot, row.key, row.kind, "condition_failed", None, None)]
    if row.kind == "delete" and not found:
        return held, [(row.arrival, row.slot, row.key, row.kind, "noop", None, None)]
    version, created = (version + 1, created) if found else (1, row.at)
    held = (row.kind == "put", version if row.kind == "put" else 0, created, row.at)
    return held, [(row.arrival, row.slot, row.key, row.kind, "applied", version, created)]


def conditional_writes(requests: DataFrame) -> DataFrame:
    """Outcome of each request in order of arrival, with the sequence that applied ones take in their slot.

    Conditions are met before an absent delete turns into nothing; failed and
    empty requests take no sequence. An outcome needs its key's state only, so
    requests are folded by key, and sequences come from a window by slot.
    Nulls in the condition columns ask for nothing. Times are microseconds.
    """
    asked = requests.select("arrival", "slot", "key", "kind", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "want_exists", "version_op", F.col("want_version").cast("bigint").alias("want_version"), "time_op", F.unix_micros(F.col("want_time").cast("timestamp")).alias("want_time"))
    done = streamed(asked, ["slot", "key"], ["arrival"], lambda row: (False, 0, None, None), _write, "arrival bigint, slot int, key string, kind string, outcome string, version bigint, created bigint")
    ranked = F.when(F.col("outcome") == "applied", F.sum((F.col("outcome") == "applied").cast("bigint")).over(W.partitionBy("slot").orderBy("arrival").rowsBetween(W.unboundedPreceding, W.currentRow)))
    return done.select("arrival", "slot", "key", "kind", "outcome", ranked.alias("sequence"), "version", F.timestamp_micros("created").alias("created_at"))


def intervals(samples: DataFrame, by: str, length_us: int) -> DataFrame:
    """Data-driven intervals (by, interval, started, ended, total, failed): a sample that comes ``length_us`` or more after
    the interval's start closes it, itself included, and starts the next; the last ends with its last sample. An interval
    without samples is not listed."""

    def start(row) -> tuple:
        return (getattr(row, by), 0, row.at, row.at, 0, 0)

    def step(held, row):
        group, k, began, _, total, failed = held
        total, failed = total + 1, failed + (not row.successful)
        if row.at - began >= length_us:
            return (group, k + 1, row.at, row.at, 0, 0), [(group, k, began, row.at, total, failed)]
        return (group, k, began, row.at, total, failed), []

    rows = samples.select(by, "seq", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "successful")
    got = streamed(rows, [by], ["seq"], start, step, f"`{by}` string, interval bigint, started bigint, ended bigint, total bigint, failed bigint", lambda held: [held] if held[4] else [])
    return got.withColumn("started", F.timestamp_micros("started")).withColumn("ended", F.timestamp_micros("ended"))
