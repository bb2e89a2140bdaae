"""Media columns: a Spark data source over directories of archives of media members.

An archive is its members one after the other, then an index of them (Arrow),
its length and a mark. A write adds a list of its archives to the directory.
Reading plans partitions as byte ranges of all listed archives; each takes the
members that begin in its range, streams them as Arrow batches, and tries a
member that fails again by itself, at its offset, from a fresh handle. Members
here are 8-bit grey images (PNG) of 576 samples a row.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from keelson.llm.common import open_fs, shared_dir

WIDTH = 576
MARK = b"KEELARC1"
INDEX = "_archives"
#: Bytes of an archive, of a planned range at least, and of a batch of payloads; tries of a member and seconds before the second; ranges that a plan has about at most.
ARCHIVE, RANGE, BATCH, TRIES, PAUSE, PLANNED = 256 << 20, 8 << 20, 4 << 20, 3, 0.05, 20_000
_MEMBERS = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())])


def payload_of(text: str | None) -> bytes:
    """UTF-8 and bytes 255 up to a positive multiple of 576."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """A grey 8-bit PNG, 576 wide, whose samples are the payload; the same bytes for the same payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate((np.zeros((len(rows), 1), np.uint8), rows), axis=1).tobytes()
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, 6)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of a grey 8-bit PNG without row filters; ValueError if it is damaged."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, width, height = 8, b"", 0, 0
    while at + 8 <= len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if struct.pack(">I", zlib.crc32(kind + body)) != media[at + 8 + n : at + 12 + n]:
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
            if body[8:10] != b"\x08\x00":
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a row is filtered")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit hash of which sixty-fourths lie above the mean."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    entropy = -float((p[p > 0] * np.log2(p[p > 0])).sum())
    edges = np.arange(64) * len(x) // 64
    means = np.add.reduceat(x.astype(np.int64), edges) / np.diff(np.append(edges, len(x)))
    bits = int("".join("1" if m else "0" for m in means > x.mean()), 2)
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={entropy:.4f};hash={bits:016x}"


# --- the data source ----------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, int, int]]  # name, bytes of members, bytes in all


@dataclass
class ByteRange(InputPartition):
    uri: str
    begin: int
    end: int
    size: int  # of the whole archive

    def __post_init__(self) -> None:
        super().__init__(self.uri)


class ArchiveWriter(DataSourceArrowWriter):
    """Each task writes archives of its own; those of tasks that are not committed are in no listing.

    All files of one write have its name in front, so that an aborted one can
    be cleared away. Writes to one directory add up, unless they overwrite.
    """

    def __init__(self, uri: str, archive: int, overwrite: bool = False):
        self.uri, self.archive, self.overwrite, self.job = uri, archive, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = open_fs(self.uri)
        fs.create_dir(base, recursive=True)
        made: list[tuple[str, int, int]] = []
        out, name, rows, at = None, "", [], 0

        def close() -> None:
            nonlocal out, rows, at
            index = io.BytesIO()
            with pa.ipc.new_stream(index, _MEMBERS) as w:
                w.write_batch(pa.RecordBatch.from_pylist(rows, _MEMBERS))
            tail = index.getvalue()
            out.write(tail + struct.pack("<Q", len(tail)) + MARK)
            out.close()
            made.append((name, at, at + len(tail) + 16))
            out, rows, at = None, [], 0

        for batch in iterator:
            for doc_id, media in zip(batch.column("doc_id").to_pylist(), batch.column("media")):
                if out is None:
                    name = f"{self.job}-{uuid.uuid4().hex}.arc"
                    out = fs.open_output_stream(f"{base}/{name}")
                media = media.as_py()
                out.write(media)
                rows.append({"doc_id": doc_id, "offset": at, "length": len(media), "crc": zlib.crc32(media)})
                at += len(media)
                if at >= self.archive:
                    close()
        if out is not None:
            close()
        return Written(made)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = open_fs(self.uri)
        fs.create_dir(base, recursive=True)
        before = _listings(fs, base) if self.overwrite else []
        with fs.open_output_stream(f"{base}/{INDEX}-{self.job}.tmp") as out:
            out.write(json.dumps([a for m in messages if m for a in m.archives]).encode())
        fs.move(f"{base}/{INDEX}-{self.job}.tmp", f"{base}/{INDEX}-{self.job}.json")
        for path in before:
            fs.delete_file(path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = open_fs(self.uri)
        for info in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            if info.base_name.startswith(f"{self.job}-"):
                fs.delete_file(info.path)


def _listings(fs: pafs.FileSystem, base: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(base))
    return sorted(x.path for x in found if x.base_name.startswith(f"{INDEX}-") and x.base_name.endswith(".json"))


class ArchiveReader(DataSourceReader):
    def __init__(self, uris: list[str], span: int, tries: int):
        self.uris, self.span, self.tries = uris, span, tries

    def partitions(self) -> list[ByteRange]:
        """Byte ranges of all listed archives; they grow with the total, so that a plan stays short. Members have no part in it."""
        listed: list[tuple[str, int, int]] = []
        for uri in self.uris:
            fs, base = open_fs(uri)
            for path in _listings(fs, base):
                with fs.open_input_stream(path, compression=None) as f:
                    listed += [(f"{uri}/{name}", data, size) for name, data, size in json.loads(f.read())]
        span = max(self.span, -(-sum(data for _, data, _ in listed) // PLANNED))
        out = [ByteRange(uri, a, min(a + span, data), size) for uri, data, size in listed for a in range(0, data, span)]
        return out or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        with Archive(partition.uri) as f:
            members = _again(lambda: _index(f.handle, partition.size), self.tries, f.reopen)
            begin = np.asarray(members["offset"])
            mine = members.slice(int(np.searchsorted(begin, partition.begin)), int(np.searchsorted(begin, partition.end) - np.searchsorted(begin, partition.begin)))
            rows, held = [], 0
            for m in mine.to_pylist():
                media, error = None, None
                try:
                    media = _again(lambda: _member(f.handle, m), self.tries, f.reopen)
                except (OSError, ValueError) as e:  # this member only; the others are read
                    error = str(e)
                rows.append({"doc_id": m["doc_id"], "archive": os.path.basename(f.path), "offset": m["offset"], "media": media, "error": error})
                held += m["length"]
                if held >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, _READ)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _READ)


class Archive:
    """An open archive whose handle can be had anew."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self._handle: pa.NativeFile | None = None

    @property
    def handle(self) -> pa.NativeFile:
        if self._handle is None:
            self._handle = self.fs.open_input_file(self.path)
        return self._handle

    def reopen(self) -> None:
        """Gives the handle up; the next use opens another."""
        old, self._handle = self._handle, None
        if old is not None:
            try:
                old.close()
            except OSError:
                pass  # it is given up because it fails

    def __enter__(self) -> Archive:
        return self

    def __exit__(self, *_) -> None:
        self.reopen()


_READ = pa.schema([("doc_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("error", pa.string())])


def _again(fn, tries: int, between=lambda: None):
    """``fn()``, up to ``tries`` times; before each further one ``between()``, and a pause twice as long as the last."""
    for k in range(tries):
        try:
            return fn()
        except (OSError, ValueError):
            if k + 1 == tries:
                raise
            between()
            time.sleep(PAUSE * 2**k)


def _index(f: pa.NativeFile, size: int) -> pa.Table:
    f.seek(size - 16)
    n, mark = struct.unpack("<Q8s", f.read(16))
    if mark != MARK:
        raise ValueError("an archive without its mark")
    f.seek(size - 16 - n)
    return pa.ipc.open_stream(f.read(n)).read_all().combine_chunks()


def _member(f: pa.NativeFile, m: dict) -> bytes:
    f.seek(m["offset"])
    media = f.read(m["length"])
    if len(media) != m["length"] or zlib.crc32(media) != m["crc"]:
        raise ValueError(f"member at {m['offset']} is damaged")
    return media


class ArchiveSource(DataSource):
    """``spark.read.format("keelson_archive").load(directory)``: doc_id, archive, offset, media, error.

    Options: ``paths`` (a JSON list of directories, instead of one),
    ``range_bytes``, ``tries``; to write, ``archive_bytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "keelson_archive"

    def schema(self) -> str:
        return "doc_id bigint, archive string, offset bigint, media binary, error string"

    def _uris(self) -> list[str]:
        return json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(self._uris(), int(self.options.get("range_bytes", RANGE)), int(self.options.get("tries", TRIES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], int(self.options.get("archive_bytes", ARCHIVE)), overwrite)


def write_archives(media: DataFrame, path: str, archive_bytes: int = ARCHIVE) -> None:
    """Writes rows (doc_id, media) as archives under ``path``."""
    media.sparkSession.dataSource.register(ArchiveSource)
    media.select("doc_id", "media").write.format("keelson_archive").option("path", path).option("archive_bytes", archive_bytes).mode("append").save()


def read_archives(spark: SparkSession, *paths: str, range_bytes: int = RANGE) -> DataFrame:
    """All members of the archives in the directories."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("keelson_archive").option("paths", json.dumps(list(paths))).option("range_bytes", range_bytes).load()


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, media) of rows (doc_id, text), handed on by bytes: an Arrow column holds 2 GB at most."""
    for batch in batches:
        start, held, size = 0, [], 0
        for i, t in enumerate(batch.column("text")):
            held.append(encode_png(payload_of(t.as_py())))
            size += len(held[-1])
            if size >= BATCH or i + 1 == len(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(held)), pa.array(held, pa.binary())], names=["doc_id", "media"])
                start, held, size = i + 1, [], 0


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, media) of every row; an id that is no whole number becomes null."""
    return docs.select(F.col(doc_id).try_cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_encoded, "doc_id bigint, media binary")


_FEATURES = T.StructType([T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))])


def features_of(media: bytes) -> dict:
    payload = decode_png(media)
    return {
        "n_bytes": len(payload.rstrip(b"\xff")),  # no UTF-8 text has a byte 255
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-32:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": feature_of(payload),
    }


@F.arrow_udf(_FEATURES)
def _features(media: pa.Array) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.array([features_of(m.as_py()) if m.is_valid else None for m in media], to_arrow_type(_FEATURES))


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, range_bytes: int = RANGE) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error) of every row.

    Every whole text becomes an image in an archive in the shared folder, and
    all columns are computed from what is read back. Null texts are empty,
    whose payload is 576 bytes of 255. A member that stays damaged after all
    tries has null columns and an error. Repeated rows and null ids are kept;
    an id that is no whole number becomes null.
    """
    path = path or shared_dir(docs.sparkSession, "media")
    write_archives(encoded(docs, doc_id, text), path)
    read = read_archives(docs.sparkSession, path, range_bytes=range_bytes)
    return read.select("doc_id", _features("media").alias("f"), "error").select("doc_id", "f.*", "error")
