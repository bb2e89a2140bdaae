"""WARC archives and their fixity, audited by Merkle trees.

Pages are written as WARC records, one gzip member each, with an index of their
offsets (a table). A tree hashes records with their offsets and lengths, then
ordered ranges of FAN_IN nodes below, up to one root a file; files are grouped
by the first digits of their names' hashes, up to one root a replica, so a file
more or less changes no other branch. Two replicas, each by its own index, are
compared at the root; only branches that differ are followed to the records.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import open_fs, shared_dir, written

#: Children of a node, and bytes of a file before the next is begun.
FAN_IN, FILE = 16, 64 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id bigint, file string, seq bigint, offset bigint, length bigint"


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A WARC 1.1 resource record; null columns are empty. Spaces and control characters of the URL are percent-encoded."""
    body = (html or "").encode("utf-8", "surrogatepass")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url or "")
    head = (
        f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {target}\r\n"
        f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return head.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; ValueError if it does not hold together."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n" or len(rest) != n + 4:
        raise ValueError("the record's length differs")
    return fields, rest[:n]


def _write(batches: Iterator[pa.RecordBatch], uri: str, limit: int) -> Iterator[pa.RecordBatch]:
    fs, base = open_fs(uri)
    fs.create_dir(base, recursive=True)
    out, name, seq, at = None, "", 0, 0
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if out is None:
                name, seq, at = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            member = gzip.compress(record(r["page_id"], r["url"], r["html"]), 6, mtime=0)
            out.write(member)
            rows.append((r["page_id"], name, seq, at, len(member)))
            seq, at = seq + 1, at + len(member)
            if at >= limit:
                out.close()
                out = None
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["page_id", "file", "seq", "offset", "length"])
    if out is not None:
        out.close()


def write_warc(pages: DataFrame, uri: str, file_bytes: int = FILE) -> DataFrame:
    """Writes the pages as WARC files and gives their index; a task tried again leaves files that no index has."""
    rows = pages.select(F.col("page_id").try_cast("bigint").alias("page_id"), "url", "html")
    return written(rows.mapInArrow(lambda it: _write(it, uri, file_bytes), INDEX), "warc-index")


def _read(batches: Iterator[pa.RecordBatch], uri: str, blocks: bool) -> Iterator[pa.RecordBatch]:
    """Leaves of rows of an index, read file by file, and their blocks if asked for: all in one reading."""
    fs, base = open_fs(uri)
    f, name = None, None
    try:
        for batch in batches:
            found = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                try:
                    if file != name:
                        if f is not None:
                            f.close()
                        f, name = None, None
                        f, name = fs.open_input_file(f"{base}/{file}"), file
                    f.seek(offset)
                    raw = f.read(length)
                except OSError:  # a lost file or a short one is a difference to find, not a failure
                    raw = b""
                found.append((leaf(raw, offset, length), *(block(raw) if blocks else (None, None, None))))
            cols = list(zip(*found)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.bool_()))]], names=[*batch.schema.names, "hash", "n_bytes", "block_sha256", "intact"])
    finally:
        if f is not None:
            f.close()


def leaf(raw: bytes, offset: int, length: int) -> str:
    """Hash of a record's stored bytes and of where its index has them."""
    return hashlib.sha256(b"%d:%d:" % (offset, length) + hashlib.sha256(raw).digest()).hexdigest()


def block(raw: bytes) -> tuple:
    """Size and digest of a record's block, and whether it is what the record says; nulls if it cannot be read."""
    try:
        fields, body = parse(gzip.decompress(raw))
        digest = hashlib.sha256(body).hexdigest()
        return len(body), digest, fields.get("warc-block-digest") == f"sha256:{digest}"
    except (OSError, EOFError, ValueError, KeyError, zlib.error):
        return None, None, False


def leaves(index: DataFrame, uri: str, blocks: bool = False) -> DataFrame:
    """The index with the hash of each record as it is stored now, and with n_bytes, block_sha256 and intact of its block, if asked for."""
    return written(index.mapInArrow(lambda it: _read(it, uri, blocks), INDEX + ", hash string, n_bytes bigint, block_sha256 string, intact boolean"), "leaves")


def _hashed(children: DataFrame, keys: list, child: str) -> DataFrame:
    """Nodes, each a hash of its children's hashes in order; a node has about FAN_IN of them."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(child, "hash"))), lambda x: F.concat(x[child].cast("string"), F.lit(":"), x["hash"]))
    return written(children.groupBy(*keys).agg(F.sha2(F.concat_ws(",", ordered).cast("binary"), 256).alias("hash")), "merkle")


class Tree:
    """Levels of hashes over the leaves of a replica: (file, node, hash) up to one node 0 a file, then (prefix, hash) up to the empty prefix.

    ``top`` is the largest seq of a record and ``depth`` the digits of the
    longest prefix; trees that are compared have them in common.
    """

    def __init__(self, found: DataFrame, top: int, depth: int):
        self.levels = [found.select("file", F.col("seq").alias("node"), "hash")]
        while top:
            self.levels.append(_hashed(self.levels[-1], ["file", F.floor(F.col("node") / FAN_IN).alias("node")], "node"))
            top //= FAN_IN
        self.files = self.levels[-1].select("file", "hash")
        self.prefixes = [_hashed(self.files.withColumn("name", F.col("file")), [F.substring(F.sha2("file", 256), 1, depth).alias("prefix")], "name")]
        for k in range(depth - 1, -1, -1):
            below = self.prefixes[-1].withColumn("name", F.col("prefix"))
            self.prefixes.append(_hashed(below, [F.substring("prefix", 1, k).alias("prefix")], "name"))


def _unlike(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose hashes differ, or that one side alone has."""
    other = b.select(*[F.col(k).alias(f"other_{k}") for k in keys], F.col("hash").alias("other_hash"))
    same = [F.col(k) == F.col(f"other_{k}") for k in keys]
    both = a.join(other, same, "full_outer").where(~F.col("hash").eqNullSafe(F.col("other_hash")))
    return written(both.select(*[F.coalesce(k, f"other_{k}").alias(k) for k in keys]), "differing")


def differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(file, seq) of the records that differ between two tables of leaves, or that one alone has, found from the root down.

    A level is read only for the children of nodes that differ above it; where
    the roots agree, nothing below them is read.
    """
    n = ours.unionByName(theirs).agg(F.max("seq"), F.approx_count_distinct("file")).first()
    depth = 0
    while FAN_IN**depth < (n[1] or 0):
        depth += 1
    a, b = (Tree(x, n[0] or 0, depth) for x in (ours, theirs))
    none = ours.select("file", "seq").limit(0)
    bad = None
    for k, (x, y) in enumerate(zip(reversed(a.prefixes), reversed(b.prefixes))):
        if k:
            x, y = (t.where(F.col("prefix") != "").join(bad.withColumnRenamed("prefix", "up"), F.substring("prefix", 1, k - 1) == F.col("up"), "left_semi") for t in (x, y))
        bad = _unlike(x, y, ["prefix"])
        if bad.isEmpty():
            return none
    x, y = (t.files.join(bad, F.substring(F.sha2("file", 256), 1, depth) == F.col("prefix"), "left_semi") for t in (a, b))
    bad = _unlike(x, y, ["file"]).withColumn("node", F.lit(0).cast("bigint"))
    for k, (x, y) in enumerate(zip(reversed(a.levels), reversed(b.levels))):
        up = bad.withColumnRenamed("node", "up")
        own = F.floor(F.col("node") / FAN_IN) if k else F.col("node")
        x, y = (t.withColumn("up", own.cast("bigint")).join(up, ["file", "up"], "left_semi").drop("up") for t in (x, y))
        bad = _unlike(x, y, ["file", "node"])
    return bad.select("file", F.col("node").alias("seq"))


def _copied(batches: Iterator[pa.RecordBatch], source: str, target: str, damage) -> Iterator[pa.RecordBatch]:
    fs, base = open_fs(source)
    to_fs, to = open_fs(target)
    to_fs.create_dir(to, recursive=True)
    for batch in batches:
        for file, rotten in zip(batch.column("file").to_pylist(), batch.column("rotten").to_pylist()):
            hurt = {r["offset"]: r["length"] for r in rotten}
            with fs.open_input_stream(f"{base}/{file}", compression=None) as src, to_fs.open_output_stream(f"{to}/{file}", compression=None) as out:
                at = 0
                for offset in sorted(hurt):
                    out.write(src.read(offset - at))
                    out.write(damage(src.read(hurt[offset])))
                    at = offset + hurt[offset]
                while part := src.read(1 << 22):
                    out.write(part)
        yield batch.select(["file"])


def flip(raw: bytes) -> bytes:
    """Bytes with one bit in their middle flipped."""
    k = len(raw) // 2
    return raw[:k] + bytes([raw[k] ^ 16]) + raw[k + 1 :]


def replicate(index: DataFrame, source: str, target: str, rotten: Column | None = None) -> None:
    """Copies the files of an index; records for which ``rotten`` holds suffer a flipped bit on the way, to drill an audit."""
    hurt = F.when(F.lit(False) if rotten is None else rotten, F.struct("offset", "length"))
    files = index.groupBy("file").agg(F.collect_list(hurt).alias("rotten"))
    done = files.mapInArrow(lambda it: _copied(it, source, target, flip), "file string")
    written(done, "copied")


def audit(index: DataFrame, replica: str, other: str, other_index: DataFrame | None = None) -> DataFrame:
    """(page_id, file, seq, offset, length, n_bytes, block_sha256, intact, differs): records as ``replica`` stores them, and whether the other replica differs there.

    The other replica goes by its own index, if it has one. Records that it
    alone has come last, with intact null. An empty index gives no rows; a lost
    or short file differs in all records that it lost. Equal records at
    different offsets are told apart.
    """
    ours, theirs = leaves(index, replica, True), leaves(other_index if other_index is not None else index, other)
    bad = differing(ours, theirs).withColumn("differs", F.lit(True))
    here = ours.join(bad, ["file", "seq"], "left").withColumn("differs", F.coalesce("differs", F.lit(False)))
    there = theirs.join(bad, ["file", "seq"]).join(ours.select("file", "seq"), ["file", "seq"], "left_anti")
    return here.unionByName(there).select("page_id", "file", "seq", "offset", "length", "n_bytes", "block_sha256", "intact", "differs")


def fixity_drill(pages: DataFrame, rotten: Column, file_bytes: int = FILE) -> DataFrame:
    """Writes ``pages`` to a replica, copies it with decay where ``rotten`` (of page_id) holds, and audits the two.

    (page_id, n_bytes, block_sha256, intact, differs) of every page, repeated
    ones and null ids included; an id that is no whole number becomes null. Null
    urls and pages are empty.
    """
    spark = pages.sparkSession
    first, second = shared_dir(spark, "warc"), shared_dir(spark, "warc")
    index = write_warc(pages, first, file_bytes)
    replicate(index, first, second, rotten)
    return audit(index, first, second).select("page_id", "n_bytes", "block_sha256", "intact", "differs")
