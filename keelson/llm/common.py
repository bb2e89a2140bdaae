"""What the corpus operators share: the shared folder, tables written between jobs, and folds by id."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only in local
    mode, where driver and executors are one process, a temporary folder stands
    in for an absent setting; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="keelson-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI such as spark.checkpoint.dir holds (file:, hdfs:, s3: ...)."""
    u = urlparse(uri)
    if u.scheme in ("", "file"):
        return pafs.LocalFileSystem(), u.path
    return pafs.FileSystem.from_uri(uri)


def fold_of(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, mod ``n``; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def text_slices(batch: pa.Array | pa.ChunkedArray, max_chars: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """Slices (start, texts) of an Arrow text column of about ``max_chars`` each; null is empty text.

    A text is never cut: one longer than the limit makes a slice of its own.
    """
    start, held, size = 0, [], 0
    for i, x in enumerate(batch):
        t = x.as_py() or ""
        if held and size + len(t) > max_chars:
            yield start, held
            start, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield start, held


def per_text(fn: Callable[[list[str]], list], dtype: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    """Body of an Arrow UDF that applies ``fn`` to bounded slices of a text column."""

    def run(col: pa.Array) -> pa.Array:
        out: list = []
        for _, texts in text_slices(col):
            out.extend(fn(texts))
        return pa.array(out, type=dtype)

    return run


def least_hashed(rows: DataFrame, by: str, n: int, h: str = "h") -> DataFrame:
    """Rows whose hash is low in their ``by`` group, about 3 n different hashes of each; the n least are among them.

    Sorting for the n least would meet in one task with n rows from every task
    that reads; after this there are 3 n a group, however many tasks there are.
    Groups are few by nature: labels, or languages of which a model holds a
    column each. So their bounds are broadcast.
    """
    different = rows.groupBy(by).agg(F.approx_count_distinct(h).cast("double").alias("different"))
    share = F.least(3.0 * n / F.greatest("different", F.lit(1.0)), F.lit(1.0))
    bounds = different.select(F.col(by).alias("of"), F.when(share < 1, (share * 2.0**64 - 2.0**63).cast("bigint")).otherwise((1 << 63) - 1).alias("bound"))
    return rows.join(F.broadcast(bounds), F.col(by) == F.col("of")).where(F.col(h) <= F.col("bound")).drop("of", "bound")
