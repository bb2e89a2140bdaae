"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A document is copied target / source_size times on average. The whole part is
certain; the fractions are rounded by pairing documents of one source: mass in
words moves between the two, in a random direction whose odds keep each one's
expectation, until one of them is whole. So a source's taken words stay put,
but for the last fraction of each source. Pairing runs along short lists, and
what a list leaves over goes up a reduction tree of lists of the same length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.llm.common import written

#: Items of a list of the tree on average, share of all words that a mix takes, and its most copies of a source.
FAN_IN, SHARE, MOST = 24, 1.5, 2.0
SEED = 20240117


def word_count(text: str | Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text: word starts, counted after spaces become one kind; null: 0."""
    c = F.col(text) if isinstance(text, str) else text
    bare = F.translate(c, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(bare, " +"), "")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size): targets by weight, capped at ``most`` times the source's size.

    Sources by code point, null last, get the weights in turn. Sharing the
    excess over the caps again and again ends where all uncapped sources have
    one level a weight; in order of cap a weight, the capped ones come first,
    so running sums find that level. Windows run over one row a source.
    """
    # strings compare by their UTF-8 bytes, which is code point order
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = W.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(whole) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    by_level = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    all_rows = W.partitionBy()
    ranked = (
        per.withColumn("total", share * F.sum("source_size").over(all_rows).cast("double"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("w").over(by_level.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level", F.greatest(F.col("total") - F.col("capped"), F.lit(0.0)) / F.col("open"))
    )
    # the level holds from the first source whose cap is not below it
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))).over(all_rows)["level"]
    return ranked.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def _uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(F.lit(SEED), *cols), F.lit(1 << 52)) / float(1 << 52)


def _paired(items: Column, level: int) -> Column:
    """Folds a list of items (key, n, x): the last state has the decided ones and the one left with a fraction.

    For two items with n and m words and fractions x and y, the mass x n + y m
    stays. Moving it towards the first ends at a first fraction of ``up`` more,
    towards the second at ``down`` less; the odds down : up keep x in mean.
    """
    item = "struct<key: struct<doc_id: bigint, size: bigint, at: int>, rows: bigint, n: double, x: double>"
    start = F.struct(F.lit(None).cast(item).alias("left"), F.array().cast(f"array<{item}>").alias("done"))

    def step(s: Column, b: Column) -> Column:
        a = s["left"]
        up = F.least(1.0 - a["x"], b["x"] * b["n"] / a["n"])
        down = F.least(a["x"], (1.0 - b["x"]) * b["n"] / a["n"])
        move = F.when(_uniform(F.lit(level), a["key"]["doc_id"], a["key"]["at"], b["key"]["doc_id"], b["key"]["at"]) * (up + down) < down, up).otherwise(-down)
        to_a = a["x"] + move
        to_b = b["x"] - move * a["n"] / b["n"]
        whole = lambda x: F.when(x < 1e-9, 0.0).when(x > 1 - 1e-9, 1.0).otherwise(x)
        na, nb = a.withField("x", whole(to_a)), b.withField("x", whole(to_b))
        settled = na["x"].isin(0.0, 1.0)
        after = F.struct(F.when(settled, nb).otherwise(na).alias("left"), F.concat(s["done"], F.array(F.when(settled, na).otherwise(nb))).alias("done"))
        return F.when(a.isNull(), F.struct(b.alias("left"), s["done"].alias("done"))).otherwise(after)

    return F.aggregate(items, start, step)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = SHARE, most: float = MOST, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken) of every row of ``docs``.

    taken is copies times size; copies differ from target / source_size by
    less than one. Reruns agree, whatever the partitions: draws depend on ids,
    sizes and levels. Rows alike in id, size and source share one item, which
    takes its whole copies at once and leaves one fraction to be paired, so a
    hot id is never one list. Null texts have size 0, a null source is a
    source of its own, a null id is an id like others. Documents of size 0
    take nothing; a source without words has target 0. Only the three named
    columns are read; texts stay where they are read.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), word_count(F.col(text)).alias("size"), F.col(source).alias("source"))
    items = written(rows.groupBy("doc_id", "size", "source").agg(F.count("*").alias("rows")), "sizes")
    targets = written(source_targets(items.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, share, most), "targets")
    counts = items.groupBy("source").agg(F.count("*").alias("in_source"))
    per_source = targets.join(counts, targets["source"].eqNullSafe(counts["source"])).select(targets["source"].alias("from"), "source_size", "target", "in_source")
    known = items.join(F.broadcast(per_source) if per_source.count() <= 100_000 else per_source, F.col("source").eqNullSafe(F.col("from"))).drop("from")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = known.withColumn("base", F.when(F.col("size") > 0, F.floor(rate + 1e-12)).otherwise(0)).withColumn("part", F.when(F.col("size") > 0, F.greatest(rate - F.floor(rate + 1e-12), F.lit(0.0))).otherwise(0.0))
    # of the alike rows of an item so many take one more for certain, and one has a fraction left
    known = known.withColumn("more", F.floor(F.col("rows") * F.col("part") + 1e-9)).withColumn("x", F.col("rows") * F.col("part") - F.col("more"))
    known = known.withColumn("x", F.when(F.col("x") < 1e-9, 0.0).otherwise(F.col("x")))
    item = F.struct(F.struct("doc_id", "size", F.lit(0).alias("at")).alias("key"), "rows", F.col("size").cast("double").alias("n"), "x")
    bucket = lambda level: F.pmod(F.xxhash64(F.lit(SEED), F.lit(level), "item.key"), F.greatest(F.ceil(F.col("in_source") / F.lit(float(fan_in ** (level + 1)))), F.lit(1)))
    open_ = known.where("x > 0").select("source", "in_source", item.alias("item"))
    decided = None
    level, most_items = 0, targets.join(counts, targets["source"].eqNullSafe(counts["source"])).agg(F.max("in_source")).first()[0] or 0
    while open_ is not None:
        lists = open_.groupBy("source", bucket(level).alias("list")).agg(F.max("in_source").alias("in_source"), F.sort_array(F.collect_list("item")).alias("items"))
        folded = written(lists.select("source", "in_source", _paired(F.col("items"), level).alias("s")), "pairs")
        done = folded.select("source", F.explode("s.done").alias("item"))
        decided = done if decided is None else decided.unionByName(done)
        left = folded.select("source", "in_source", F.col("s.left").alias("item"))
        if fan_in ** (level + 1) >= most_items:
            # one fraction is left of a source: rounded at random by its own odds
            last = left.withColumn("item", F.col("item").withField("x", F.when(_uniform(F.col("source"), F.col("item.key.doc_id")) < F.col("item.x"), 1.0).otherwise(0.0)))
            decided = decided.unionByName(last.select("source", "item"))
            open_ = None
        else:
            open_, level = left, level + 1
    won = decided.where("item.x = 1.0").select(F.col("item.key.doc_id").alias("won_id"), F.col("item.key.size").alias("won_size"), F.col("source").alias("won_source"))
    settled = known.join(won, F.col("doc_id").eqNullSafe(F.col("won_id")) & (F.col("size") == F.col("won_size")) & F.col("source").eqNullSafe(F.col("won_source")), "left")
    settled = settled.withColumn("more", F.col("more") + F.when(F.col("won_size").isNotNull(), 1).otherwise(0))
    # the rows of an item again, the first ones with one copy more
    chunk = 1 << 16
    wide = settled.withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("rows") - 1) / chunk))))
    each = wide.withColumn("i", F.explode(F.sequence(F.col("c") * chunk, F.least((F.col("c") + 1) * chunk, F.col("rows")) - 1)))
    copies = F.col("base") + F.when(F.col("i") < F.col("more"), 1).otherwise(0)
    return each.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
