"""Files of a run directory: written by tasks into the shared folder, as their rows come."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from itertools import batched, groupby
from operator import itemgetter
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of files that a task reads, names of files that it hashes, and lines of a batch.
SHARE, NAMES, ROWS = 64 << 20, 100_000, 10_000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir; in local mode a temporary one if that is not set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="keelson-")
    return f"{base if ':' in base else 'file://' + base}/{name}-{uuid.uuid4().hex}"


def lines_of(rows: DataFrame, path: Column, order: list[str], line: Column, parts: bool = False) -> DataFrame:
    """(path, content), a row a line, of text files from their lines in order, so that no row or task holds a file.

    Lines of a file are one task's, which writes them as they come. Files that
    grow with the run have ``parts``: lines are dealt to tasks by ranges of path
    and order, and a file is a folder with a part of each task, named in order.
    """
    held = rows.withColumn("path", path)
    held = (held.repartitionByRange("path", *order) if parts else held.repartition("path")).sortWithinPartitions("path", *order)
    name = F.concat("path", F.format_string("/part-%05d", F.spark_partition_id())) if parts else F.col("path")
    return held.select(name.alias("path"), F.coalesce(F.concat(line, F.lit("\n")), F.lit("")).cast("binary").alias("content"))


def _open(base: str) -> tuple[pafs.FileSystem, str]:
    u = urlparse(base)
    return (pafs.LocalFileSystem(), u.path) if u.scheme in ("", "file") else pafs.FileSystem.from_uri(base)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(path, bytes) of the rows of one path that follow each other in a batch."""
    for batch in batches:
        runs, at = pc.run_end_encode(batch.column("path")), 0
        for path, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            yield path, b"".join(batch.column("content").slice(at, end - at).to_pylist())
            at = end


def _write(batches: Iterator[pa.RecordBatch], base: str) -> Iterator[pa.RecordBatch]:
    (fs, root), made = _open(base), None

    def done() -> Iterator[tuple[str, int, str]]:
        nonlocal made
        for path, contents in groupby(_stretches(batches), itemgetter(0)):
            if made != (folder := f"{root}/{path}".rpartition("/")[0]):
                fs.create_dir(made := folder, recursive=True)
            h, size = hashlib.sha256(), 0
            with fs.open_output_stream(f"{root}/{path}", compression=None) as out:
                for _, content in contents:
                    out.write(content)
                    h.update(content)
                    size += len(content)
            yield path, size, h.hexdigest()

    for rows in batched(done(), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], names=["path", "size", "sha256"])


def _written(files: DataFrame, base: str) -> DataFrame:
    return files.select("path", "content").mapInArrow(lambda it: _write(it, base), "path string, size bigint, sha256 string")


def put_files(files: DataFrame, base: str) -> None:
    """Writes rows (path, content) under ``base``; rows of one path that follow each other in a task make one file.

    A task tried again writes the same bytes to the same place. Without rows ``base`` is an empty folder.
    """
    fs, root = _open(base)
    fs.create_dir(root, recursive=True)
    _written(files, base).write.format("noop").mode("overwrite").save()


def write_files(files: DataFrame, base: str) -> list[tuple[str, int, str]]:
    """Writes as put_files does, and gives the manifest: path, size and SHA-256 of each file, by path."""
    return sorted(map(tuple, _written(files, base).collect()))


def put_named(files: DataFrame, base: str) -> DataFrame:
    """Writes as put_files does, and gives the manifest as a table in the shared folder: for files so many that their names are too much for the driver."""
    folder = shared_dir(files.sparkSession, "manifest")
    _written(files, base).write.parquet(folder)
    return files.sparkSession.read.schema("path string, size bigint, sha256 string").parquet(folder)


def dealt(files: DataFrame) -> DataFrame:
    """Paths of a manifest, dealt to tasks, which open the files by name."""
    n, size = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), files.agg(F.sum("size")).first()[0] or 0
    return files.select("path").repartition(max(n, -(-size // SHARE)), "path")


def _lines(batches: Iterator[pa.RecordBatch], base: str) -> Iterator[pa.RecordBatch]:
    fs, root = _open(base)

    def found() -> Iterator[tuple[str, int, bytes]]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with fs.open_input_stream(f"{root}/{path}", compression=None) as src:
                    n, rest = 0, b""
                    while part := src.read(1 << 20):
                        whole, end, rest = (rest + part).rpartition(b"\n")
                        for n, line in enumerate((whole + end).splitlines(), n + 1):
                            yield path, n, line
                    if rest:
                        yield path, n + 1, rest

    for rows in batched(found(), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], names=["path", "line", "value"])


def lines_in(files: DataFrame, base: str) -> DataFrame:
    """(path, line, value) of the text files of a manifest below ``base``: lines from 1, in batches over files."""
    found = dealt(files).mapInArrow(lambda it: _lines(it, base), "path string, line bigint, value binary")
    return found.withColumn("value", F.col("value").cast("string"))


def _hashed(batches: Iterator[pa.RecordBatch], base: str) -> Iterator[pa.RecordBatch]:
    fs, root = _open(base)
    for batch in batches:
        rows = []
        for path in batch.column("path").to_pylist():
            h, size = hashlib.sha256(), 0
            with fs.open_input_stream(f"{root}/{path}", compression=None) as src:
                while part := src.read(1 << 22):
                    h.update(part)
                    size += len(part)
            rows.append((path, size, h.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["path", "size", "sha256"])


def _entries(batches: Iterator[pa.RecordBatch], base: str, own: str) -> Iterator[pa.RecordBatch]:
    fs, root = _open(base)

    def inside(folder: str) -> Iterator[tuple[str, bool, bool]]:
        if isinstance(fs, pafs.LocalFileSystem):
            with os.scandir(folder) as listing:
                yield from ((x.name, x.is_dir(), x.is_file()) for x in listing)
        else:  # gives no names before it has all of a folder
            yield from ((x.base_name, x.type == pafs.FileType.Directory, x.type == pafs.FileType.File) for x in fs.get_file_info(pafs.FileSelector(folder)))

    def found() -> Iterator[tuple[str, bool]]:
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                for name, is_folder, is_file in inside(f"{root}/{folder}"):
                    path = f"{folder}/{name}" if folder else name
                    if (is_folder or is_file) and f"{root}/{path}" != own:
                        yield path, is_folder

    for rows in batched(found(), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.bool_()))], names=["path", "folder"])


def listed(spark: SparkSession, base: str) -> DataFrame:
    """(path) of all files below ``base``: folders of a level are listed by tasks, which write the names as they come, so that the driver holds none."""
    base, names, level, levels = base.rstrip("/"), shared_dir(spark, "listing"), spark.range(1, numPartitions=1).select(F.lit("").alias("path")), []
    own = _open(names)[1]
    while not levels or not level.isEmpty():
        levels.append(f"{names}/{len(levels)}")
        level.mapInArrow(lambda it: _entries(it, base, own), "path string, folder boolean").write.parquet(levels[-1])
        found = spark.read.schema("path string, folder boolean").parquet(levels[-1])
        level = found.where("folder").select("path").repartition("path")
    return spark.read.schema("path string, folder boolean").parquet(*levels).where("not folder").select("path")


def manifest(spark: SparkSession, base: str) -> DataFrame:
    """(path, size, sha256) of all files below ``base`` by path, empty ones too: names are listed and contents hashed by tasks."""
    found, n = listed(spark, base), int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = found.repartitionByRange(max(n, -(-found.count() // NAMES)), "path").sortWithinPartitions("path")
    return names.mapInArrow(lambda it: _hashed(it, base), "path string, size bigint, sha256 string")
