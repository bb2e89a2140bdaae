"""The engine's inputs as views of the tables in a directory of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.functions.hashing import slot_of

SLOTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def operations(spark: SparkSession, sf_dir: str, slots: int = SLOTS) -> DataFrame:
    """Operation log (arrival, at, slot, key, kind, value): one of a user's events each; errors are deletes."""
    key = F.concat(F.lit("user-"), "user_id")
    kind = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("arrival"), F.col("ts").alias("at"), slot_of(key, slots).alias("slot"), key.alias("key"), kind.alias("kind"), F.col("props").alias("value"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency samples (seq, at, scenario, operation, latency_ms, successful): the day of an event is its scenario."""
    op = F.when(F.col("event_type").isin("view", "click"), "get").otherwise("put")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.date_format("ts", "yyyy-MM-dd").alias("scenario"), op.alias("operation"), F.col("value").alias("latency_ms"), (F.col("event_type") != "error").alias("successful"))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Increments of a histogram family (seq, scenario, target, stage, role, result, value), to be summed into snapshots."""
    e = table(spark, sf_dir, "events")
    role = F.when(F.col("user_id") % 2 == 0, "head").otherwise("tail")
    result = F.when(F.col("value") > 100, "slow").otherwise("success")
    return e.select(F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd").alias("scenario"), F.concat(F.lit("store-"), F.col("user_id") % 3).alias("target"), F.col("event_type").alias("stage"), role.alias("role"), result.alias("result"), (F.col("value") / 1000).alias("value"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes (n, node_id, rpc_address, domains): suppliers, whose nation and region are failure domains."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    domains = F.create_map(F.lit("nation"), "n_name", F.lit("region"), "r_name")
    return joined.select(F.col("s_suppkey").alias("n"), F.col("s_name").alias("node_id"), F.concat(F.lit("10.0.0."), "s_suppkey").alias("rpc_address"), domains.alias("domains"))


def replicas(spark: SparkSession, sf_dir: str, factor: int = 3) -> DataFrame:
    """Chain members (slot, pos, n, node_id, state): parts are slots, each on the suppliers of its line items, by number.

    A chain is by definition the first factor + 1 suppliers, as the queries' SQL
    has it (pos <= 3). Later ones are no members: no query sees a longer chain,
    and they count as outsiders.
    """
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("slot"), F.col("l_suppkey").alias("n"), "l_linenumber").groupBy("slot", "n").agg(F.min("l_linenumber").alias("line"))
    placed = li.withColumn("pos", F.row_number().over(W.partitionBy("slot").orderBy("line", "n")) - 1).where(F.col("pos") < factor + 1)
    state = F.when(F.col("line") == 7, "leaving").when(F.col("line") == 6, "joining").otherwise("active")
    return placed.join(nodes(spark, sf_dir).select("n", "node_id"), "n").select("slot", F.col("pos").cast("bigint").alias("pos"), "n", "node_id", state.alias("state"))


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats (node_id, seq, at, state): users are nodes; an error is a suspicion."""
    state = F.when(F.col("event_type") == "error", "suspect").when((F.col("event_type") == "signup") & (F.col("value") > 40), "dead").otherwise("healthy")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("node-"), "user_id").alias("node_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), state.alias("state"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host probes (node_id, seq, at, idle, total, network): the events of a user; its second interface comes and goes."""
    card = lambda rx: F.struct(rx.alias("rx"), (F.col("event_id") * 300_000).alias("tx"))
    first, second = card(F.col("event_id") * 900_000), card(F.col("event_id") * 700_000 % 50_000_000)
    network = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("eth0"), first)).otherwise(F.create_map(F.lit("eth0"), first, F.lit("eth1"), second))
    total = F.col("event_id") * 100 + F.floor("value") % 50
    return table(spark, sf_dir, "events").select(F.concat(F.lit("node-"), "user_id").alias("node_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), (F.col("event_id") * 60).alias("idle"), total.alias("total"), network.alias("network"))
