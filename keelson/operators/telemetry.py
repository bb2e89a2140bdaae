"""Telemetry of runs: latency summaries, histograms, counter differences, shares, traces, timeouts and host rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.functions.conditions import first_reason

# Upper bounds of the latency histogram, in milliseconds
BOUNDS = [0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0]


def percentile(c: str | Column, p: float) -> Column:
    """Exact percentile by linear interpolation; 0 of nothing."""
    return F.coalesce(F.percentile(c, min(p, 100) / 100), F.lit(0.0))


def mean(c: str | Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """a / b * scale, or 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")) * scale, F.lit(0.0))


def latency_summary(samples: DataFrame, by: list[str]) -> DataFrame:
    """Operations, successes, errors, percentiles and maximum of each group; latencies of failed operations count too."""
    ok = F.count_if("successful")
    return samples.groupBy(*by).agg(
        F.count("*").alias("total_ops"), ok.alias("success_ops"), (F.count("*") - ok).alias("error_ops"),
        percentile("latency_ms", 50).alias("p50_ms"), percentile("latency_ms", 95).alias("p95_ms"), percentile("latency_ms", 99).alias("p99_ms"), F.coalesce(F.max("latency_ms"), F.lit(0.0)).alias("max_ms"),
    )


def scenario_summary(samples: DataFrame, measured: DataFrame, by: str = "scenario") -> DataFrame:
    """``latency_summary`` with reads, writes (whatever isn't a get) and operations a second of the measured ``seconds``."""
    mix = samples.groupBy(by).agg(F.count_if(F.col("operation") == "get").alias("read_ops"), F.count_if(F.col("operation") != "get").alias("write_ops"))
    return latency_summary(samples, [by]).join(mix, by).join(F.broadcast(measured), by, "left").withColumn("throughput", ratio(F.col("total_ops"), F.col("seconds")))


def histogram(samples: DataFrame, by: str, value: str = "latency_ms", bounds: list[float] = BOUNDS) -> DataFrame:
    """(by, upper, n): samples at or below each bound and above the one before, empty buckets too.

    Groups with a sample above the last bound get a bucket more, whose bound is
    their maximum rounded up. Counting is one pass with partial sums by bucket.
    """
    uppers = F.array(*[F.lit(float(b)) for b in bounds])
    at = F.size(F.filter(uppers, lambda u: F.col(value) > u))
    counted = samples.where(F.col(value).isNotNull()).groupBy(by, at.alias("at")).agg(F.count("*").alias("n"), F.max(value).alias("most"))
    per = counted.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("ns"), F.max("most").alias("most"))
    last = F.when(F.col("most") > bounds[-1], F.array(F.ceil("most").cast("double"))).otherwise(F.array().cast("array<double>"))
    return per.select(by, "ns", F.posexplode(F.concat(uppers, last)).alias("at", "upper")).select(by, "upper", F.coalesce(F.try_element_at("ns", F.col("at")), F.lit(0)).cast("bigint").alias("n"))


def bucket_quantile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """(by, quantile): upper edge of the first bucket that reaches floor(n q) of the counts, 1 at least; not interpolated."""
    run, whole = W.partitionBy(*by).orderBy("upper"), W.partitionBy(*by)
    cum = buckets.withColumn("cum", F.sum("n").over(run)).withColumn("want", F.greatest(F.floor(F.sum("n").over(whole) * q), F.lit(1)))
    return cum.where("cum >= want").groupBy(*by).agg(F.min("upper").alias("quantile"))


def aligned_intervals(samples: DataFrame, by: str, length: str) -> DataFrame:
    """Interval summaries on a fixed grid, which Spark aggregates without order; ``folds.intervals`` has those that samples open and close."""
    w = F.window("at", length)
    return samples.groupBy(by, w["start"].alias("started")).agg(F.count("*").alias("total"), F.count_if(~F.col("successful")).alias("failed"), percentile("latency_ms", 50).alias("p50_ms"))


def measured(ops: DataFrame, warm_until: Column, ended: Column) -> DataFrame:
    """Marks operations: ``warm_up`` before the warm-up ends, ``late`` if begun or cancelled after the end, else ``measured``."""
    return ops.withColumn("phase", F.when(F.col("at") < warm_until, "warm_up").when(F.col("at") >= ended, "late").otherwise("measured"))


# --- snapshots of counters ----------------------------------------------------------------------


def snapshot(points: DataFrame, by: list[str]) -> DataFrame:
    """Counts and sums of a family over its targets."""
    return points.groupBy(*by).agg(F.count("*").alias("count"), F.sum("value").alias("sum"))


def snapshot_diff(end: DataFrame, start: DataFrame, by: list[str]) -> DataFrame:
    """Differences of two snapshots: what only the end has begins at zero, what only the start has is gone, a reset gives 0."""
    before = start.select(*by, F.col("count").alias("c0"), F.col("sum").alias("s0"))
    less = lambda a, b: F.greatest(F.col(a) - F.coalesce(b, F.lit(0)), F.lit(0))
    return end.join(before, by, "left").select(*by, less("count", "c0").alias("count"), less("sum", "s0").cast("double").alias("sum"))


def mean_ms(count: str = "count", total: str = "sum") -> Column:
    """Mean of a difference in thousandths; 0 of nothing."""
    return ratio(F.col(total), F.col(count), 1000)


def shares(diff: DataFrame, by: list[str], part: str) -> DataFrame:
    """Sum, mean and percent of its group's total of each part, ranked by sum and then by name."""
    w = W.partitionBy(*by)
    summed = diff.groupBy(*by, part).agg(F.sum("count").alias("count"), F.sum("sum").alias("sum")).withColumn("mean_ms", mean_ms())
    return summed.withColumn("share", ratio(F.col("sum"), F.sum("sum").over(w), 100)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("sum"), part)))


def dominant(shared: DataFrame, by: list[str], part: str) -> DataFrame:
    """The first part of each group, and whether it stands out: a share of 35 or more, and half as much again as the next."""
    after = F.lead("sum").over(W.partitionBy(*by).orderBy("rank"))
    clear = (F.col("share") >= 35) & ((F.coalesce("next", F.lit(0.0)) == 0) | (F.col("sum") >= 1.5 * F.col("next")))
    return shared.withColumn("next", after).where("rank = 1").select(*by, F.col(part).alias("dominant"), clear.alias("clear"))


def record_mix(diff: DataFrame, by: list[str], kind: str) -> DataFrame:
    """Kinds of records that grew, with their percent of all."""
    grown = diff.where("count > 0").groupBy(*by, kind).agg(F.sum("count").alias("records"))
    return grown.withColumn("share", ratio(F.col("records"), F.sum("records").over(W.partitionBy(*by)), 100))


def gauge_max(gauges: DataFrame) -> DataFrame:
    """(name, value): greatest positive value by kind@target; the kind alone if no target is named, the file if no kind is."""
    kind, target = (F.coalesce(c, F.lit("")) for c in ("kind", "target"))
    name = F.when(kind == "", F.col("file")).when(target == "", kind).otherwise(F.concat(kind, F.lit("@"), target))
    return gauges.where("value > 0").groupBy(name.alias("name")).agg(F.max("value").alias("value"))


def experiment(labels: DataFrame, default: str | None = None) -> DataFrame:
    """The least label that isn't empty, else the default, else ``baseline_json_sync``: one row."""
    return labels.agg(F.coalesce(F.min(F.when(F.col("experiment") != "", F.col("experiment"))), F.lit(default or None), F.lit("baseline_json_sync")).alias("experiment"))


def storage_floor(current: DataFrame, control: DataFrame) -> DataFrame:
    """(name, current_ms, control_ms, ratio): median of the nodes' p50 by test, beside that of the control path."""
    median = lambda df, c: df.groupBy("name").agg(percentile("p50_ms", 50).alias(c))
    both = median(current, "current_ms").join(median(control, "control_ms"), "name", "left").withColumn("control_ms", F.coalesce("control_ms", F.lit(0.0)))
    return both.withColumn("ratio", ratio(F.col("current_ms"), F.col("control_ms")))


# --- traces and timeouts ------------------------------------------------------------------------


def earliest(events: DataFrame, by: list[str], stages: list[str]) -> DataFrame:
    """One row a trace with the earliest time of each stage: a pivot over a given list, so nothing is collected."""
    return events.where(F.col("stage").isin(stages)).groupBy(*by).agg(*[F.min(F.when(F.col("stage") == s, F.col("at"))).alias(s) for s in stages])


def durations(traces: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(name, samples, mean_ms) of the time between pairs of stages; missing or reversed ones don't count."""
    ms = lambda a, z: F.when(F.col(z) >= F.col(a), (F.unix_micros(F.col(z).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / 1000)
    spans = F.array(*[F.struct(F.lit(n).alias("name"), ms(a, z).alias("ms")) for n, (a, z) in pairs.items()])
    return traces.select(F.inline(spans)).where("ms is not null").groupBy("name").agg(F.count("*").alias("samples"), mean("ms").alias("mean_ms"))


def in_scenarios(writes: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Writes with each scenario that measured them, both ends included. Scenarios are few by nature: a run has dozens."""
    return writes.join(F.broadcast(scenarios), (F.col("at") >= F.col("measured_from")) & (F.col("at") <= F.col("measured_to")))


def near(traces: DataFrame, sequence: str, span: int, limit: int) -> DataFrame:
    """Events of a slot within ``span`` of an asked sequence, the last ``limit`` of them."""
    close = traces.where(F.abs(F.col("sequence") - F.col(sequence)) <= span)
    return close.withColumn("back", F.row_number().over(W.partitionBy("slot").orderBy(F.desc("at"), F.desc("sequence")))).where(F.col("back") <= limit).drop("back")


def stuck_sequence() -> Column:
    """Next sequence, else that after the highest committed, else the write's own; 0 stands for none."""
    return F.coalesce(F.nullif("next_sequence", F.lit(0)), F.nullif("highest_committed", F.lit(0)) + 1, F.col("sequence"))


def fingerprint(sessions: Column, *fields: str) -> Column:
    """Sorted and joined texts of the sessions' fields."""
    return F.array_join(F.array_sort(F.transform(sessions, lambda s: F.concat_ws("/", *[s[f].cast("string") for f in fields]))), "|")


def timeout_roots(artifacts: DataFrame) -> DataFrame:
    """Timeouts by (node_id, slot, stuck): first and last seen, errors, what changed in between, and the likely stage.

    Artifacts have at, node_id, slot, sequence, error, next_sequence,
    highest_committed, slot_durable, journal_durable, upstream_in_flight,
    upstream_confirmed, applied and sessions. Ties in time go to the sequence.
    """
    a = artifacts.withColumn("stuck", stuck_sequence()).withColumn("durable", F.greatest(F.coalesce("journal_durable", F.lit(0)), "slot_durable"))
    row, when = F.struct(*[c for c in a.columns if c not in ("node_id", "slot", "stuck")]), F.struct("at", "sequence", "artifact_id")
    late = F.contains("error", F.lit("context deadline exceeded"))
    g = a.groupBy("node_id", "slot", "stuck").agg(
        F.min_by(row, when).alias("f"), F.max_by(row, when).alias("l"), F.count_if(late).alias("deadline_errors"), F.count_if(~late & F.contains("error", F.lit("context canceled"))).alias("canceled"),
    )
    changed = lambda *fs: fingerprint(F.col("f.sessions"), "kind", "target", *fs) != fingerprint(F.col("l.sessions"), "kind", "target", *fs)
    stuck, durable, committed, sessions = F.col("stuck"), F.col("l.durable"), F.col("l.highest_committed"), F.col("l.sessions")
    stage = first_reason(
        ((durable >= stuck) & (committed < stuck), "slot_owner_apply_or_reconcile"),
        (F.exists(sessions, lambda s: (s["spool"] > 0) & ((s["credit"] == 0) | s["blocked"])), "sender_spool_or_credit"),
        (F.col("l.upstream_in_flight") & (F.col("l.upstream_confirmed") < committed), "upstream_replay_or_confirm_debt"),
        (F.exists(sessions, lambda s: (s["sent"] >= stuck) & (s["acked"] < stuck)) & (durable < stuck), "receiver_delivery_or_journal"),
    )
    return g.select(
        "node_id", "slot", "stuck", F.col("f.at").alias("first_seen"), F.col("l.at").alias("last_seen"), committed.alias("highest_committed"), durable.alias("durable"), "deadline_errors", "canceled",
        changed("credit").alias("credit_changed"), changed("spool", "sent", "acked").alias("spool_changed"), (F.col("f.durable") != durable).alias("durable_moved"),
        (F.struct("f.highest_committed", "f.applied") != F.struct("l.highest_committed", "l.applied")).alias("apply_changed"), F.coalesce(stage, F.lit("unknown")).alias("likely_stage"),
        F.concat_ws("/", "node_id", "slot", "stuck").alias("place"),
    )


# --- series -------------------------------------------------------------------------------------


def changes(progress: DataFrame, by: list[str], order: str, watched: list[str]) -> DataFrame:
    """Rows whose watched columns differ from the row before; the first of each group counts."""
    prior = F.lag(F.struct(*watched)).over(W.partitionBy(*by).orderBy(order))
    return progress.withColumn("prior", prior).where(~F.col("prior").eqNullSafe(F.struct(*watched))).drop("prior")


def routing_progress(records: DataFrame, by: list[str]) -> DataFrame:
    """Samples, seconds in all, to the first readable slot and to all writable (0: never, or at once), and maxima, in order of ``seq``."""
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    first = F.min_by(micros, "seq")
    since = lambda c: F.coalesce((F.min_by(F.when(c, micros), F.when(c, F.col("seq"))) - first) / 1e6, F.lit(0.0))
    return records.groupBy(*by).agg(
        F.count("*").alias("samples"), ((F.max_by(micros, "seq") - first) / 1e6).alias("total_s"),
        since(F.col("readable") > 0).alias("first_readable_s"), since((F.col("slots") > 0) & (F.col("writable") == F.col("slots"))).alias("all_writable_s"),
        *[F.max(c).alias(f"max_{c}") for c in ("pending", "outbox", "refreshes")],
    )


def stalls(progress: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Adds the running best, whether a row improved on it, and rows since it last did."""
    w = W.partitionBy(*by).orderBy(order)
    before = F.max(value).over(w.rowsBetween(W.unboundedPreceding, -1))
    out = progress.withColumn("i", F.row_number().over(w)).withColumn("best", F.max(value).over(w)).withColumn("improved", F.coalesce(F.col(value) > before, F.lit(True)))
    return out.withColumn("stalled", F.col("i") - F.last(F.when(F.col("improved"), F.col("i")), True).over(w)).drop("i")


def polyline(points: DataFrame, by: list[str], order: str, value: str, width: float, height: float) -> DataFrame:
    """Adds x and y of a chart's line: evenly spread, scaled to the group's maximum."""
    w, whole = W.partitionBy(*by).orderBy(order), W.partitionBy(*by)
    top = F.when(F.max(value).over(whole) == 0, 1).otherwise(F.max(value).over(whole))
    i, n = F.row_number().over(w) - 1, F.count("*").over(whole)
    return points.withColumn("x", F.when(n > 1, width * i / F.greatest(n - 1, F.lit(1))).otherwise(0.0)).withColumn("y", height - height * F.col(value) / top)


def host_rates(probes: DataFrame) -> DataFrame:
    """(node_id, seq, seconds, cpu_percent, rx_mb_s, tx_mb_s): differences to the probe before, in order of ``seq``.

    Probes have idle and total ticks and a map of interfaces to {rx, tx}. Pairs
    that take no time are left out after the lag, so they still are the probe
    before. A new interface counts from 0, one that is gone is ignored, a
    counter that went back gives 0.
    """
    prior = F.lag(F.struct("at", "idle", "total", "network")).over(W.partitionBy("node_id").orderBy("seq"))
    p = probes.withColumn("p", prior).where("p is not null")
    p = p.withColumn("seconds", (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("p.at").cast("timestamp"))) / 1e6).where("seconds > 0")
    ticks = F.col("total") - F.col("p.total")
    busy = F.when(ticks > 0, 100.0 * (1 - (F.col("idle") - F.col("p.idle")) / ticks)).otherwise(0.0)
    moved = lambda f: F.aggregate(F.map_entries("network"), F.lit(0).cast("bigint"), lambda s, e: s + F.greatest(e["value"][f] - F.coalesce(F.try_element_at("p.network", e["key"])[f], F.lit(0)), F.lit(0)))
    return p.select("node_id", "seq", "seconds", busy.alias("cpu_percent"), (moved("rx") / F.col("seconds") / 1024 / 1024).alias("rx_mb_s"), (moved("tx") / F.col("seconds") / 1024 / 1024).alias("tx_mb_s"))


def metric_rows(values: DataFrame) -> DataFrame:
    """Rows ``name = value`` with three decimals."""
    return values.select("name", F.format_string("%s = %.3f", "name", "value").alias("row"))


def verify_manifest(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem) of a manifest's files: missing, size or checksum, in that order; null if a file is whole."""
    there = found.select("path", F.col("size").alias("size_now"), F.col("sha256").alias("sha256_now"))
    problem = first_reason((F.col("size_now").isNull(), "missing"), (F.col("size") != F.col("size_now"), "size"), (F.col("sha256") != F.col("sha256_now"), "checksum"))
    return listed.join(there, "path", "left").select("path", problem.alias("problem"))
