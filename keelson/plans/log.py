"""Queries of the versioned log: replay, state, reads, journals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions.conditions import holds
from keelson.functions.hashing import shard_of, slot_of
from keelson.operators import folds
from keelson.operators import log as L
from keelson.plans.names import query
from keelson.sources.tables import SLOTS, operations, table

# CRC-32 of a key, bit by bit: SQL has no function for it
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ord(substr(key, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
OPS = f"""WITH keys AS (SELECT DISTINCT user_id, 'user-' || user_id AS key FROM events),
slots AS (SELECT user_id, key, CAST({_CRC} % {SLOTS} AS INTEGER) AS slot FROM keys),
ops AS (SELECT event_id AS arrival, ts AS "at", slot, key, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS kind, props AS value FROM events JOIN slots USING (user_id))"""
LOG = f"""{OPS},
marked AS (SELECT *, kind = 'put' OR coalesce(lag(kind) OVER (PARTITION BY slot, key ORDER BY arrival) = 'put', false) AS applied FROM ops),
eff AS (SELECT *, coalesce(sum(CASE WHEN kind = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY slot, key ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM marked WHERE applied),
log AS (SELECT arrival, slot, key, kind, value, "at" AS updated_at,
    row_number() OVER (PARTITION BY slot, key, life ORDER BY arrival) AS version,
    first_value("at") OVER (PARTITION BY slot, key, life ORDER BY arrival) AS created_at,
    row_number() OVER (PARTITION BY slot ORDER BY arrival) AS sequence FROM eff)"""
# a log split by slot: local_sequence is committed at this replica, tail_sequence at the tail
CUTS = "cuts AS (SELECT slot, CAST(floor(max(sequence) * 0.6) AS BIGINT) AS local_sequence, CAST(floor(max(sequence) * 0.8) AS BIGINT) AS tail_sequence FROM log GROUP BY slot)"


def _log(spark, sf):
    return L.replay(operations(spark, sf))


def _cuts(log: DataFrame) -> DataFrame:
    top = log.groupBy("slot").agg(F.max("sequence").alias("top"))
    return top.select("slot", F.floor(F.col("top") * 0.6).alias("local_sequence"), F.floor(F.col("top") * 0.8).alias("tail_sequence"))


@query("PRJ1_key_slot", f"{OPS} SELECT DISTINCT key, slot FROM ops")
def key_slot(spark, sf):
    keys = table(spark, sf, "events").select(F.concat(F.lit("user-"), "user_id").alias("key")).distinct()
    return keys.select("key", slot_of("key", SLOTS).alias("slot"))


@query("PRJ4_slot_shard", f"{OPS} SELECT slot, CAST(slot % 4 AS INTEGER) AS shard, count(*) AS ops FROM ops GROUP BY slot")
def slot_shard(spark, sf):
    return operations(spark, sf).groupBy("slot").agg(F.count("*").alias("ops")).select("slot", shard_of("slot", 4).alias("shard"), "ops")


@query("WIN1_slot_sequence", f"{LOG} SELECT arrival, slot, sequence FROM log")
def slot_sequence(spark, sf):
    return _log(spark, sf).select("arrival", "slot", "sequence")


@query("WIN2_replay", f"{LOG} SELECT arrival, slot, key, kind, value, sequence, version, created_at, updated_at FROM log")
def replay(spark, sf):
    return _log(spark, sf).select("arrival", "slot", "key", "kind", "value", "sequence", "version", "created_at", "updated_at")


@query("WIN3_suppressed_deletes", f"{LOG} SELECT arrival, slot, key FROM marked WHERE NOT applied")
def suppressed(spark, sf):
    return L.effective(operations(spark, sf)).where("not applied").select("arrival", "slot", "key")


STATE = "SELECT slot, key, value, version, created_at, updated_at, sequence FROM (SELECT *, row_number() OVER (PARTITION BY slot, key ORDER BY sequence DESC) AS r FROM log{where}) WHERE r = 1 AND kind = 'put'"


@query("SNK2_materialized_state", f"{LOG} {STATE.format(where='')}")
def materialized(spark, sf):
    return L.state(_log(spark, sf))


@query("SRC3_slot_snapshot", f"{LOG} SELECT * FROM ({STATE.format(where=' WHERE slot = 3')})")
def slot_snapshot(spark, sf):
    return L.state(_log(spark, sf).where("slot = 3"))


ASKED = "asked AS (SELECT DISTINCT 'user-' || (user_id * 2) AS key FROM events)"


@query("SRC1_point_get", f"{LOG}, {ASKED}, st AS ({STATE.format(where='')}), numbered AS (SELECT key, CAST({_CRC} % {SLOTS} AS INTEGER) AS slot FROM asked) SELECT n.slot, n.key, st.key IS NOT NULL AS found, st.value, st.version FROM numbered n LEFT JOIN st ON n.key = st.key")
def point_get(spark, sf):
    key = F.concat(F.lit("user-"), F.col("user_id") * 2).alias("key")
    keys = table(spark, sf, "events").select(key).distinct().select(slot_of("key", SLOTS).alias("slot"), "key")
    return L.point_get(L.state(_log(spark, sf)), keys)


@query("SRC4_staged_sequences", f"{LOG}, {CUTS} SELECT slot, sequence FROM log JOIN cuts USING (slot) WHERE sequence > local_sequence")
def staged(spark, sf):
    log = _log(spark, sf).select("slot", "sequence")
    return log.join(_cuts(log), "slot").where("sequence > local_sequence").select("slot", "sequence")


@query("SRC6_log_after", f"{OPS} SELECT arrival, key, kind FROM ops WHERE arrival > 500")
def log_after(spark, sf):
    return operations(spark, sf).where("arrival > 500").select("arrival", "key", "kind")


@query("SRC29_committed_sequence", f"{LOG} SELECT slot, max(sequence) AS sequence FROM log GROUP BY slot")
def committed_sequence(spark, sf):
    return _log(spark, sf).groupBy("slot").agg(F.max("sequence").alias("sequence"))


@query("SRC27_snapshot_with_sequence", f"{LOG}, st AS ({STATE.format(where='')}) SELECT slot, top AS committed, count(st.key) AS objects FROM (SELECT slot, max(sequence) AS top FROM log GROUP BY slot) LEFT JOIN st USING (slot) GROUP BY slot, top")
def snapshot_with_sequence(spark, sf):
    last = L.latest(_log(spark, sf))
    return last.groupBy("slot").agg(F.max("sequence").alias("committed"), F.count_if(F.col("kind") == "put").alias("objects"))


@query("AOF1_as_of_read", f"{LOG}, {CUTS}, upto AS (SELECT log.* FROM log JOIN cuts USING (slot) WHERE sequence <= tail_sequence) {STATE.format(where='').replace('FROM log', 'FROM upto')}")
def as_of(spark, sf):
    log = _log(spark, sf)
    cut = log.join(_cuts(log), "slot")
    objects = L.latest(cut.where("sequence <= local_sequence"))
    return L.read_as_of(objects, cut.where("sequence > local_sequence").drop("local_sequence", "tail_sequence"), _cuts(log).select("slot", "tail_sequence"))


@query("AOF2_local_read", f"{LOG}, {CUTS}, upto AS (SELECT log.* FROM log JOIN cuts USING (slot) WHERE sequence <= local_sequence) {STATE.format(where='').replace('FROM log', 'FROM upto')}")
def local_read(spark, sf):
    log = _log(spark, sf)
    cut = log.join(_cuts(log), "slot").where("sequence <= local_sequence").drop("local_sequence", "tail_sequence")
    half = F.col("sequence") % 2 == 0
    # what is in the state and what is only in its overlay, looked up in that order of precedence
    base, over = L.latest(cut.where(~half)), L.latest(cut.where(half))
    newer = over.join(base.select("slot", "key", F.col("sequence").alias("in_base")), ["slot", "key"], "left").where("in_base is null or sequence > in_base").drop("in_base")
    return L.overlay(base, newer).where("kind = 'put'").drop("kind")


@query("SET2_buffered_sequences", f"{LOG} SELECT DISTINCT slot, sequence FROM (SELECT slot, sequence FROM log WHERE sequence % 2 = 0 UNION ALL SELECT slot, sequence FROM log WHERE sequence % 3 = 0)")
def buffered(spark, sf):
    log = _log(spark, sf).select("slot", "sequence")
    return log.where("sequence % 2 = 0").union(log.where("sequence % 3 = 0")).distinct()


@query("SET3_overlay_merge", f"{LOG}, {CUTS}, base AS (SELECT key, slot FROM log JOIN cuts USING (slot) WHERE sequence <= local_sequence), late AS (SELECT log.* FROM log JOIN cuts USING (slot) WHERE sequence > local_sequence), o AS (SELECT slot, key, last(kind ORDER BY sequence) AS kind FROM late GROUP BY slot, key), b AS (SELECT slot, key, last(kind ORDER BY sequence) AS kind FROM log JOIN cuts USING (slot) WHERE sequence <= local_sequence GROUP BY slot, key) SELECT slot, key FROM b WHERE kind = 'put' AND NOT EXISTS (SELECT 1 FROM o WHERE o.key = b.key AND o.slot = b.slot) UNION ALL SELECT slot, key FROM o WHERE kind = 'put'")
def overlay_merge(spark, sf):
    log = _log(spark, sf)
    cut = log.join(_cuts(log), "slot")
    return L.overlay(L.latest(cut.where("sequence <= local_sequence")), L.latest(cut.where("sequence > local_sequence"))).where("kind = 'put'").select("slot", "key")


HOLES = "holes AS (SELECT slot, sequence, arrival FROM log WHERE arrival % 37 <> 20)"


@query("WIN13_contiguous_prefix", f"{LOG}, {HOLES} SELECT slot, CAST(coalesce(max(CASE WHEN sequence = r THEN sequence END), 0) AS BIGINT) AS prefix FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY sequence) AS r FROM holes) GROUP BY slot")
def prefix(spark, sf):
    return L.contiguous_prefix(_log(spark, sf).where("arrival % 37 <> 20"), ["slot"])


@query("STF15_gaps", f"{LOG}, {HOLES} SELECT slot, b + 1 AS first_missing, sequence - 1 AS last_missing FROM (SELECT *, coalesce(lag(sequence) OVER (PARTITION BY slot ORDER BY sequence), 0) AS b FROM holes) WHERE sequence > b + 1")
def gaps(spark, sf):
    return L.gaps(_log(spark, sf).where("arrival % 37 <> 20"), ["slot"])


@query("WIN14_high_water", f"{LOG} SELECT slot, sequence, max(sequence) OVER (PARTITION BY slot ORDER BY (arrival * 7919) % 10007, arrival ROWS UNBOUNDED PRECEDING) AS high_water FROM log")
def high_water(spark, sf):
    shuffled = _log(spark, sf).withColumn("o", F.struct(((F.col("arrival") * 7919) % 10007).alias("col1"), "arrival"))
    return L.high_water(shuffled, ["slot"], "o", bucket=F.floor(F.col("o.col1") / 256)).select("slot", "sequence", "high_water")


@query("WIN12_retained_history", f"{LOG} SELECT slot, sequence, key FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY sequence DESC) AS r FROM log) WHERE r <= 64")
def history(spark, sf):
    return L.last_n(_log(spark, sf), ["slot"], "sequence", 64).select("slot", "sequence", "key")


@query("WIN17_round_robin", f"{OPS} SELECT arrival, slot, (row_number() OVER (PARTITION BY slot ORDER BY arrival) - 1) % 3 AS replica FROM ops WHERE kind = 'put'")
def round_robin(spark, sf):
    return L.round_robin(operations(spark, sf).where("kind = 'put'"), "slot", "arrival", F.lit(3)).select("arrival", "slot", "replica")


@query("SRT10_fair_batches", f"{OPS}, t AS (SELECT *, slot % 4 AS shard, length(value) AS bytes, row_number() OVER (PARTITION BY slot ORDER BY arrival) AS turn FROM ops) SELECT arrival, CAST(greatest((row_number() OVER w - 1) // 64, coalesce(sum(bytes) OVER (PARTITION BY shard ORDER BY turn, slot, arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 512) AS BIGINT) AS batch FROM t WINDOW w AS (PARTITION BY shard ORDER BY turn, slot, arrival)")
def fair_batches(spark, sf):
    ops = operations(spark, sf).select("arrival", "slot", shard_of("slot", 4).alias("shard"), F.length("value").alias("bytes"))
    return L.fair_batches(ops, 64, 512).select("arrival", "batch")


JOURNAL = """journal AS (
    SELECT 'prepare' AS type, slot, 1 + arrival % 29 // 28 AS chain_version, sequence FROM log WHERE arrival % 53 <> 7
    UNION ALL SELECT 'commit_watermark', slot, 1, sequence FROM log WHERE sequence % 10 = 0
    UNION ALL SELECT 'upstream_confirm', slot, 1, sequence FROM log WHERE sequence % 25 = 0)"""


def _journal(spark, sf):
    log = _log(spark, sf)
    row = lambda kind, version, where: log.where(where).select(F.lit(kind).alias("type"), "slot", version.cast("bigint").alias("chain_version"), "sequence")
    return row("prepare", 1 + F.floor((F.col("arrival") % 29) / 28), "arrival % 53 <> 7").unionByName(row("commit_watermark", F.lit(1), "sequence % 10 = 0")).unionByName(row("upstream_confirm", F.lit(1), "sequence % 25 = 0"))


@query(
    "STF20_journal_replay",
    f"""{LOG}, {JOURNAL}, here AS (SELECT * FROM journal WHERE chain_version = 1),
    c AS (SELECT slot, max(sequence) FILTER (type = 'prepare') AS prepared, max(sequence) FILTER (type = 'commit_watermark') AS marked, max(sequence) FILTER (type = 'upstream_confirm') AS confirmed FROM here GROUP BY slot),
    p AS (SELECT slot, max(CASE WHEN sequence = r THEN sequence END) AS prefix FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY sequence) AS r FROM here WHERE type = 'prepare') GROUP BY slot),
    r AS (SELECT slot, CASE WHEN slot % 2 = 0 THEN 'tail' ELSE 'head' END AS role, coalesce(prepared, 0) AS prepared, CASE WHEN slot % 2 = 0 THEN coalesce(prefix, 0) ELSE coalesce(marked, 0) END AS committed, coalesce(confirmed, 0) AS confirmed
          FROM (SELECT DISTINCT slot FROM log) LEFT JOIN c USING (slot) LEFT JOIN p USING (slot))
    SELECT slot, role, CAST(prepared AS BIGINT) AS prepared, CAST(committed AS BIGINT) AS committed, CAST(confirmed AS BIGINT) AS confirmed, CAST(greatest(committed - 10 * slot, 0) AS BIGINT) AS backlog FROM r""",
)
def journal_replay(spark, sf):
    slots = _log(spark, sf).select("slot").distinct()
    assigned = slots.select("slot", F.lit(1).cast("bigint").alias("chain_version"), F.when(F.col("slot") % 2 == 0, "tail").otherwise("head").alias("role"))
    return L.replay_journal(_journal(spark, sf), assigned, slots.select("slot", (10 * F.col("slot")).cast("bigint").alias("materialized")))


@query("STF21_coalesced_watermarks", f"{LOG}, {JOURNAL} SELECT type, slot, CAST(chain_version AS BIGINT) AS chain_version, max(sequence) AS sequence, count(*) AS records FROM journal GROUP BY ALL")
def coalesced(spark, sf):
    return L.coalesced(_journal(spark, sf), ["type", "slot", "chain_version"])


@query("JON14_current_records", f"{LOG}, {JOURNAL} SELECT type, slot, sequence FROM journal WHERE chain_version = 1 + CAST(slot % 2 AS INTEGER)")
def current_records(spark, sf):
    now = operations(spark, sf).select("slot").distinct().select("slot", (1 + F.col("slot") % 2).cast("bigint").alias("chain_version"))
    return _journal(spark, sf).join(now, ["slot", "chain_version"]).select("type", "slot", "sequence")


@query("STF22_materializer_filter", f"{LOG}, {CUTS}, {HOLES} SELECT slot, sequence, CASE WHEN sequence <= local_sequence THEN 'skip' WHEN sequence = local_sequence + count(CASE WHEN sequence > local_sequence THEN 1 END) OVER (PARTITION BY slot ORDER BY sequence) THEN 'apply' ELSE 'gap' END AS action FROM holes JOIN cuts USING (slot)")
def materializer(spark, sf):
    log = _log(spark, sf)
    return L.to_materialize(log.where("arrival % 37 <> 20").select("slot", "sequence"), _cuts(log).select("slot", F.col("local_sequence").alias("materialized")))


@query("STF12_commit_watermark", f"{LOG}, {HOLES}, p AS (SELECT slot, max(CASE WHEN sequence = r THEN sequence END) AS prefix FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY sequence) AS r FROM holes) GROUP BY slot), {CUTS} SELECT slot, CAST(least(tail_sequence, coalesce(prefix, 0)) AS BIGINT) AS watermark FROM cuts LEFT JOIN p USING (slot)")
def watermark(spark, sf):
    log = _log(spark, sf)
    done = L.contiguous_prefix(log.where("arrival % 37 <> 20"), ["slot"])
    return _cuts(log).join(done, "slot", "left").select("slot", F.least("tail_sequence", F.coalesce("prefix", F.lit(0))).cast("bigint").alias("watermark"))


@query("STF18_dirty_keys", f"{LOG}, {CUTS} SELECT slot, key, count(*) AS dirty, min(sequence) AS first_dirty, max(sequence) AS last_dirty FROM log JOIN cuts USING (slot) WHERE sequence > local_sequence GROUP BY slot, key")
def dirty_keys(spark, sf):
    log = _log(spark, sf)
    dirty = log.join(_cuts(log), "slot").where("sequence > local_sequence")
    return dirty.groupBy("slot", "key").agg(F.count("*").alias("dirty"), F.min("sequence").alias("first_dirty"), F.max("sequence").alias("last_dirty"))


@query("STF23_replay_debt", f"{LOG}, {CUTS} SELECT slot, tail_sequence - local_sequence AS debt FROM cuts")
def replay_debt(spark, sf):
    return _cuts(_log(spark, sf)).select("slot", (F.col("tail_sequence") - F.col("local_sequence")).alias("debt"))


@query("STF24_credits", f"{OPS}, b AS (SELECT slot, count(*) % 80 AS buffered, count(*) % 7 = 0 AS has_gap FROM ops GROUP BY slot) SELECT slot, CAST(CASE WHEN has_gap THEN 0 ELSE least(greatest(64 - buffered, 0), 32) END AS BIGINT) AS forward_credit, CAST(CASE WHEN has_gap THEN 0 ELSE least(greatest(64 - buffered, 0), 16) END AS BIGINT) AS commit_credit, CAST(CASE WHEN has_gap THEN 0 ELSE least(greatest(64 - buffered, 0), 1) END AS BIGINT) AS advance_credit FROM b")
def credit(spark, sf):
    b = operations(spark, sf).groupBy("slot").agg((F.count("*") % 80).alias("buffered"), (F.count("*") % 7 == 0).alias("has_gap"))
    return L.credits(b).drop("buffered", "has_gap")


REQUESTS = "req AS (SELECT arrival, slot, key, CASE WHEN arrival % 4 = 0 THEN arrival % 8 = 0 END AS want_exists, CASE arrival % 6 WHEN 1 THEN 'eq' WHEN 2 THEN 'gte' WHEN 3 THEN 'odd' END AS version_op, arrival % 5 AS want_version FROM ops)"


def _requests(ops: DataFrame) -> DataFrame:
    a = F.col("arrival")
    return ops.select("arrival", "at", "slot", "key", "kind", F.when(a % 4 == 0, a % 8 == 0).alias("want_exists"), F.when(a % 6 == 1, "eq").when(a % 6 == 2, "gte").when(a % 6 == 3, "odd").alias("version_op"), (a % 5).alias("want_version"), F.lit(None).cast("string").alias("time_op"), F.lit(None).cast("timestamp_ntz").alias("want_time"))


@query("FLT1_write_conditions", f"{LOG}, {REQUESTS}, st AS ({STATE.format(where='')}) SELECT arrival, (want_exists IS NULL OR want_exists = (st.key IS NOT NULL)) AND (version_op IS NULL OR (st.key IS NOT NULL AND CASE version_op WHEN 'eq' THEN version = want_version WHEN 'gte' THEN version >= want_version ELSE false END)) AS holds FROM req LEFT JOIN st ON req.slot = st.slot AND req.key = st.key")
def write_conditions(spark, sf):
    asked = _requests(operations(spark, sf))
    now = L.state(_log(spark, sf)).select("slot", "key", "version", "updated_at", F.lit(True).alias("there"))
    c = F.col
    met = holds(F.coalesce(c("there"), F.lit(False)), c("version"), c("updated_at"), c("want_exists"), c("version_op"), c("want_version"), c("time_op"), c("want_time"))
    return asked.join(now, ["slot", "key"], "left").select("arrival", met.alias("holds"))


@query("STF1_conditional_writes")
def conditional_writes(spark, sf):
    return folds.conditional_writes(_requests(operations(spark, sf)))


@query("STF10_slot_reducer")
def slot_reducer(spark, sf):
    """Messages of a log that come out of order and twice, reduced slot by slot; the stream does the same, batch by batch."""
    from keelson.streaming.slot_reducer import reduce_messages

    log = _log(spark, sf)
    arrive = lambda shift: log.select("slot", "sequence", "key", F.coalesce("value", F.lit("")).alias("value"), (F.col("sequence") + F.floor((F.col("arrival") * shift) % 11)).alias("at"), F.lit(shift).alias("copy"))
    return reduce_messages(arrive(7919).unionByName(arrive(104729)))


@query("KVO9_committable", f"{LOG}, {CUTS}, {HOLES} SELECT slot, sequence FROM holes JOIN cuts USING (slot) WHERE sequence <= tail_sequence")
def committable(spark, sf):
    log = _log(spark, sf)
    return log.where("arrival % 37 <> 20").select("slot", "sequence").join(_cuts(log), "slot").where("sequence <= tail_sequence").select("slot", "sequence")


@query("AGG37_batch_composition", f"{LOG}, {JOURNAL} SELECT type, count(*) AS records, count(DISTINCT slot) AS slots FROM journal GROUP BY type")
def composition(spark, sf):
    return _journal(spark, sf).groupBy("type").agg(F.count("*").alias("records"), F.countDistinct("slot").alias("slots"))


@query("AGG39_sequence_window", f"{LOG}, {HOLES}, {CUTS} SELECT slot, count(*) AS n, min(sequence) AS first, max(sequence) AS last, array_to_string(list(sequence ORDER BY sequence), ',') AS listed FROM holes JOIN cuts USING (slot) WHERE sequence > tail_sequence GROUP BY slot")
def sequence_window(spark, sf):
    """Count, ends and list of the sequences that the tail has yet to commit, of every slot."""
    log = _log(spark, sf)
    open_ = log.where("arrival % 37 <> 20").select("slot", "sequence").join(_cuts(log), "slot").where("sequence > tail_sequence")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("sequence")), lambda x: x.cast("string")), ",")
    return open_.groupBy("slot").agg(F.count("*").alias("n"), F.min("sequence").alias("first"), F.max("sequence").alias("last"), listed.alias("listed"))
