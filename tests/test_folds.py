"""Stateful operators against sequential folds in plain Python, in batch and as a stream."""

import datetime as dt
import random

from pyspark.sql import functions as F

from keelson.functions.hashing import fnv1a64
from keelson.operators import folds
from keelson.operators import log as L
from keelson.operators import telemetry as M
from keelson.plans.log import _requests
from keelson.sources import tables as S
from keelson.streaming import slot_reducer as R

SF = "/root/testdata/sf0.001"


def test_conditional_writes(spark):
    asked = [r.asDict() for r in _requests(S.operations(spark, SF)).orderBy("arrival").collect()]
    state, sequence, want = {}, {}, []
    ops = {"eq": lambda a, b: a == b, "gte": lambda a, b: a >= b}
    for r in asked:
        k = (r["slot"], r["key"])
        found = k in state
        ok = r["want_exists"] is None or r["want_exists"] == found
        if r["version_op"] is not None:
            ok = ok and found and r["version_op"] in ops and ops[r["version_op"]](state[k], r["want_version"])
        if not ok:
            want.append((r["arrival"], "condition_failed", None, None))
        elif r["kind"] == "delete" and not found:
            want.append((r["arrival"], "noop", None, None))
        else:
            sequence[r["slot"]] = sequence.get(r["slot"], 0) + 1
            version = state.get(k, 0) + 1
            want.append((r["arrival"], "applied", sequence[r["slot"]], version))
            if r["kind"] == "put":
                state[k] = version
            else:
                del state[k]
    got = folds.conditional_writes(_requests(S.operations(spark, SF)))
    assert [tuple(r) for r in got.select("arrival", "outcome", "sequence", "version").orderBy("arrival").collect()] == want
    assert {x[1] for x in want} == {"applied", "noop", "condition_failed"}


def test_intervals(spark):
    t0, rng = dt.datetime(2024, 1, 1), random.Random(1)
    rows, at = [], 0.0
    for i in range(300):
        at += rng.choice([0, 0.1, 0.4, 1.0, 3.0])
        rows.append((i, t0 + dt.timedelta(seconds=at), "a" if i < 200 else "b", rng.random() > 0.2))
    df = spark.createDataFrame(rows, "seq long, at timestamp, scenario string, successful boolean")
    want = []
    for s in ("a", "b"):
        mine, began, n, k = [r for r in rows if r[2] == s], None, 0, 0
        for r in mine:
            began = began or r[1]
            n += 1
            if (r[1] - began).total_seconds() >= 2:
                want.append((s, k, n))
                began, n, k = r[1], 0, k + 1
        if n:
            want.append((s, k, n))
    got = folds.intervals(df, "scenario", 2_000_000)
    assert sorted(tuple(r) for r in got.select("scenario", "interval", "total").collect()) == want


def _messages(spark):
    rng, rows = random.Random(2), []
    for slot in range(3):
        for n in range(1, 120):
            for copy in range(2):
                value = "v" if copy == 0 or n % 13 else "other"
                rows.append((slot, n, f"k{n}", value, n + rng.randint(0, 9), copy))
    return spark.createDataFrame(rows, "slot int, sequence long, key string, value string, at long, copy int"), rows


def test_slot_reducer(spark, tmp_path):
    df, rows = _messages(spark)
    want = []
    for slot in range(3):
        s = R.start()
        for r in sorted((r for r in rows if r[0] == slot), key=lambda r: (r[4], r[5], r[1])):
            want += R.reduce_one(s, *r[:4])
        assert s["next"] == 120 and not s["early"]
    got = [tuple(r) for r in R.reduce_messages(df).collect()]
    assert sorted(got) == sorted(want)
    assert {x[4] for x in want} == {"apply", "buffer", "ignore", "conflict"}


def test_reducer_is_exact_on_gaps():
    s = R.start()
    act = lambda n, v="v": [x[4] for x in R.reduce_one(s, 0, n, "k", v)]
    assert act(2) == ["buffer"] and act(2) == ["ignore"] and act(2, "w") == ["conflict"]
    assert act(1) == ["apply", "apply"] and act(1) == ["ignore"] and act(1, "w") == ["conflict"]
    assert [act(n)[0] for n in range(4, 4 + R.BUFFER)] == ["buffer"] * R.BUFFER
    assert act(4 + R.BUFFER) == ["backpressure"]
    assert len(act(3)) == R.BUFFER + 1 and act(1) == ["stale"]


def test_journal_and_prefix_edges(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 4), (2, 3)], "slot int, sequence long")
    assert {tuple(r) for r in L.contiguous_prefix(df, ["slot"]).collect()} == {(1, 2), (2, 0)}
    assert {tuple(r) for r in L.gaps(df, ["slot"]).collect()} == {(1, 3, 3), (2, 1, 2)}
    assert L.contiguous_prefix(df.limit(0), ["slot"]).collect() == []


def test_fnv_and_histogram_edges(spark):
    import numpy as np

    h = 14695981039346656037
    for part in (3, 7, 1):
        for b in int(part).to_bytes(8, "little"):
            h = (h ^ b) * 1099511628211 % (1 << 64)
    assert int(fnv1a64(*[np.array([x], np.uint64) for x in (3, 7, 1)])[0]) == h
    df = spark.createDataFrame([("a", 0.1), ("a", 1000.0), ("b", 1000.5), ("b", None)], "operation string, latency_ms double")
    got = {(r[0], r[1]): r[2] for r in M.histogram(df, "operation").collect()}
    assert got["a", 0.1] == 1 and got["a", 1000.0] == 1 and got["b", 1001.0] == 1 and got["b", 50.0] == 0
    assert len([k for k in got if k[0] == "a"]) == 13 and len([k for k in got if k[0] == "b"]) == 14


def test_counter_reset_and_new_interface(spark):
    net = lambda **k: {n: {"rx": v, "tx": 0} for n, v in k.items()}
    t0 = dt.datetime(2024, 1, 1)
    rows = [("n", 0, t0, 0, 0, net(a=5 << 20)), ("n", 1, t0 + dt.timedelta(seconds=2), 50, 100, net(a=1 << 20, b=4 << 20)), ("n", 2, t0, 60, 110, net(b=9 << 20))]
    df = spark.createDataFrame(rows, "node_id string, seq long, at timestamp, idle long, total long, network map<string, struct<rx: long, tx: long>>")
    assert [(r["seq"], r["cpu_percent"], r["rx_mb_s"]) for r in M.host_rates(df).collect()] == [(1, 50.0, 2.0)]


def test_stream_equals_batch(spark, tmp_path):
    df, _ = _messages(spark)
    df = df.where("slot = 0").repartition(1)
    for k, low in enumerate((0, 40, 80)):
        df.where((F.col("at") >= low) & (F.col("at") < low + 40 + 100 * (k == 2))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = R.reduce_stream(stream).writeStream.format("memory").queryName("reduced").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        got = [tuple(r) for r in spark.sql("select slot, sequence, action, next from reduced where action = 'apply'").collect()]
    finally:
        spark.conf.unset(conf)
    assert sorted(got) == [(0, n, "apply", n + 1) for n in range(1, 120)]


def test_numbering_by_buckets_is_that_of_whole_windows(spark, monkeypatch):
    import random

    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from keelson.operators import log as L

    monkeypatch.setattr(L, "BUCKET", 7)
    rng = random.Random(2)
    rows = [(rng.choice([0, 0, 0, 1, 2]), x, rng.randrange(40)) for x in rng.sample(range(300), 120)]
    df = spark.createDataFrame(rows, "slot bigint, sequence bigint, bytes bigint")
    w = W.partitionBy("slot").orderBy("sequence")
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(L.numbered(df, ["slot"], "sequence", "n").select("slot", "sequence", "n"), df.select("slot", "sequence", F.row_number().over(w)))
    assert same(L.high_water(df, ["slot"], "sequence", "bytes").select("slot", "sequence", "high_water"), df.select("slot", "sequence", F.max("bytes").over(w)))
    lag = df.withColumn("b", F.coalesce(F.lag("sequence").over(w), F.lit(0))).where("sequence > b + 1").select("slot", F.col("b") + 1, F.col("sequence") - 1)
    assert same(L.gaps(df, ["slot"]), lag)
    ops = df.select("slot", F.col("sequence").alias("arrival"), (F.col("slot") % 2).alias("shard"), "bytes")
    t = ops.withColumn("turn", F.row_number().over(W.partitionBy("slot").orderBy("arrival")))
    o = W.partitionBy("shard").orderBy("turn", "slot", "arrival")
    want = t.select("arrival", F.greatest(F.floor((F.row_number().over(o) - 1) / 5), F.floor(F.coalesce(F.sum("bytes").over(o.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) / 90)))
    assert same(L.fair_batches(ops, 5, 90).select("arrival", "batch"), want)
