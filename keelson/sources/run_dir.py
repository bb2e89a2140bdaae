"""Readers of a run directory: metric snapshots, traces, timeouts, probes, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.sources.files import lines_in, shared_dir

#: The nodes whose artifacts a run has.
NODES = ["storage-a", "storage-b", "storage-c"]
#: Lines of a file that a window sorts at most.
BUCKET = 65_536


def _file() -> Column:
    """A file that is a folder of parts goes by the folder's path."""
    return F.regexp_replace(F.col("_metadata.file_path"), r"/part-\d+$", "")


_SAMPLE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+(\S+)"
_LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'


def metric_files(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """Paths of the files of a snapshot that begin with ``prefix`` and end with .prom, sorted; it is an error if there is none."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*.prom").load(folder).select("path").collect()
    if not found:
        raise FileNotFoundError(f"no metric snapshots with prefix {prefix} in {folder}")
    return sorted(r.path for r in found)


def metrics(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, family, kind, name, labels, value): all samples of text expositions; a family without a type is untyped.

    Samples of a histogram (and summary) belong to it by their suffix.
    """
    lines = spark.read.text(paths).select(_file().alias("file"), F.trim("value").alias("line"))
    part = F.split("line", r"\s+")
    types = lines.where(F.col("line").startswith("# TYPE ")).select("file", part[2].alias("family"), part[3].alias("kind")).distinct()
    labels = F.regexp_extract("line", _SAMPLE, 2)
    unescaped = lambda s: F.replace(F.replace(F.replace(s, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\"))
    values = F.transform(F.regexp_extract_all(labels, F.lit(_LABEL), F.lit(2)), unescaped)
    samples = lines.where(~F.col("line").startswith("#") & (F.col("line") != "")).select(
        "file", F.regexp_extract("line", _SAMPLE, 1).alias("name"), F.map_from_arrays(F.regexp_extract_all(labels, F.lit(_LABEL), F.lit(1)), values).alias("labels"), F.regexp_extract("line", _SAMPLE, 3).cast("double").alias("value")
    )
    # a name is tried whole, and without the suffix of a compound family
    tried = samples.withColumn("family", F.explode(F.array_distinct(F.array("name", F.regexp_replace("name", "_(bucket|sum|count)$", "")))))
    typed = tried.join(types, ["file", "family"]).where((F.col("family") == F.col("name")) | F.col("kind").isin("histogram", "summary"))
    bare = samples.join(typed.select("file", "name").distinct(), ["file", "name"], "left_anti")
    return typed.select("file", "family", "kind", "name", "labels", "value").unionByName(bare.select("file", F.col("name").alias("family"), F.lit("untyped").alias("kind"), "name", "labels", "value"))


def _without(labels: str, key: str) -> Column:
    return F.map_filter(labels, lambda k, v: k != key)


def histograms(found: DataFrame, family: str) -> DataFrame:
    """(file, labels, count, sum) of a histogram family; no rows if there is no such family."""
    h = found.where((F.col("family") == family) & (F.col("kind") == "histogram") & ~F.col("name").endswith("_bucket"))
    pick = lambda suffix: F.max(F.when(F.col("name") == family + suffix, F.col("value")))
    return h.groupBy("file", F.array_sort(F.map_entries("labels")).alias("l")).agg(pick("_count").cast("bigint").alias("count"), pick("_sum").alias("sum")).select("file", F.map_from_entries("l").alias("labels"), "count", "sum")


def gauges(found: DataFrame, family: str) -> DataFrame:
    """(file, labels, value) of a gauge family."""
    return found.where((F.col("family") == family) & (F.col("kind") == "gauge")).select("file", "labels", "value")


def counters(found: DataFrame, family: str) -> DataFrame:
    """(file, labels, value) of a counter family."""
    return found.where((F.col("family") == family) & (F.col("kind") == "counter")).select("file", "labels", "value")


def chosen_values(found: DataFrame) -> DataFrame:
    """(file, family, labels, value): one value a metric - that of a gauge, counter or untyped one, the sum of a histogram, 0 of any other."""
    labels = F.array_sort(F.map_entries(_without("labels", "le")))
    value = F.when(F.col("kind").isin("gauge", "counter", "untyped"), F.col("value")).when((F.col("kind") == "histogram") & F.col("name").endswith("_sum"), F.col("value")).when(F.col("kind") == "histogram", F.lit(None)).otherwise(0.0)
    return found.select("file", "family", labels.alias("labels"), value.alias("value")).groupBy("file", "family", "labels").agg(F.max("value").alias("value"))


def flat_metrics(found: DataFrame) -> DataFrame:
    """(file, name, value): a family's only metric goes by its name, others by name and sorted labels."""
    v = chosen_values(found)
    n = v.groupBy("file", "family").agg(F.count("*").alias("n"))
    listed = F.array_join(F.transform("labels", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return v.join(n, ["file", "family"]).select("file", F.when(F.col("n") == 1, F.col("family")).otherwise(F.concat("family", F.lit("{"), listed, F.lit("}"))).alias("name"), "value")


def json_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Records of JSON lines with file and place, a struct that ascends with the lines of a file; blank lines are skipped, broken ones are errors."""
    text = spark.read.option("recursiveFileLookup", True).text(paths).where("trim(value) <> ''")
    part = F.regexp_extract(F.col("_metadata.file_path"), r"/part-(\d+)$", 1).try_cast("int")
    place = F.struct(part.alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return text.select(_file().alias("file"), place.alias("place"), F.from_json(F.trim("value"), schema, {"mode": "FAILFAST"}).alias("r")).select("file", "place", "r.*")


def numbered(records: DataFrame) -> DataFrame:
    """Adds ``line``, the number of a record in its file from 1, to records of json_lines.

    They are written to the shared folder once, so that splits stay as they were
    read. A split's ids have no gaps: a line's number is its place among them
    and the lines of earlier splits, of which only their counts meet.
    """
    spark, folder = records.sparkSession, shared_dir(records.sparkSession, "numbered")
    records.write.parquet(folder)
    held = spark.read.parquet(folder)
    split = ["file", F.col("place.part").alias("part"), F.col("place.block").alias("block")]
    per = held.groupBy(*split).agg(F.min("place.id").alias("first"), F.count("*").alias("n"))
    earlier = F.sum("n").over(W.partitionBy("file").orderBy("part", "block").rowsBetween(W.unboundedPreceding, -1))
    per = per.select(F.col("file").alias("f"), "part", "block", "first", F.coalesce(earlier, F.lit(0)).alias("before"))
    same = (held["file"] == F.col("f")) & F.col("place.part").eqNullSafe(F.col("part")) & (F.col("place.block") == F.col("block"))
    line = F.col("before") + F.col("place.id") - F.col("first") + 1  # a row a split is broadcast
    return held.join(F.broadcast(per), same).withColumn("line", line.cast("bigint")).drop("f", "part", "block", "first", "before")


def with_previous(records: DataFrame, name: str, *cols: str) -> DataFrame:
    """Adds as ``name`` the columns of the line before in the same file, to numbered records; null at the first.

    A window sorts a bucket of lines; the last line of a bucket goes to the next one as well.
    """
    own = F.floor((F.col("line") - 1) / BUCKET)
    dealt = records.withColumn("bucket", F.explode(F.when(F.col("line") % BUCKET == 0, F.array(own, own + 1)).otherwise(F.array(own))))
    held = dealt.withColumn(name, F.lag(F.struct(*cols)).over(W.partitionBy("file", "bucket").orderBy("line")))
    return held.where(F.col("bucket") == own).drop("bucket")


TRACE = "at timestamp, node_id string, slot int, sequence bigint, chain_version bigint, role string, stage string"


def traces(spark: SparkSession, run: str) -> DataFrame:
    """Write traces of the run's nodes, by time; a node without its file is an error."""
    paths = [f"{run}/artifacts/{n}/write-pipeline-trace.jsonl" for n in NODES]
    return json_lines(spark, paths, TRACE).drop("file", "place").sort("at")


def timeouts(spark: SparkSession, run: str, schema: str) -> DataFrame:
    """Timeout artifacts of the run's nodes, by time; nodes without a file are skipped."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{write-timeout-artifacts.jsonl,part-*}").text(f"{run}/artifacts")
    mine = F.element_at(F.split(_file(), "/"), -2).isin(*NODES) & (F.element_at(F.split(_file(), "/"), -1) == "write-timeout-artifacts.jsonl")
    lines = text.where(mine).select(F.trim("value").alias("line")).where("line <> ''")
    return lines.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*").sort("at")


PROBE = (
    "timestamp timestamp, cpu struct<user: bigint, nice: bigint, system: bigint, idle: bigint, iowait: bigint, irq: bigint, softirq: bigint, steal: bigint>, "
    "network map<string, struct<rx_bytes: bigint, tx_bytes: bigint>>, disks map<string, struct<reads_completed: bigint, writes_completed: bigint, read_sectors: bigint, write_sectors: bigint>>"
)


def probes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Host probes with file and place: their order is that of the lines."""
    return json_lines(spark, paths, PROBE)


PROGRESS = "time timestamp, version bigint, slot_count int, writable_slots int, readable_slots int, settled_slots int, pending_slots int, outbox_entries int"


def progress(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, PROGRESS)


def progress_of(files: DataFrame, base: str) -> DataFrame:
    """Progress of the files of a manifest below ``base``, one a run and so very many: tasks open them by name. Blank lines are skipped, broken ones are errors."""
    text = lines_in(files, base).where("trim(value) <> ''")
    return text.select(F.col("path").alias("file"), "line", F.from_json(F.trim("value"), PROGRESS, {"mode": "FAILFAST"}).alias("r")).select("file", "line", "r.*")


def document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document, over any number of lines."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
