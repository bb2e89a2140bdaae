"""Commit journals: length-prefixed JSON records, and binary records behind a fixed head, in one file or in segments."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator
from itertools import batched
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.sources.files import _open, dealt

#: Fixed values of the format: codes of record types (any other is commit) and of kinds.
TYPES = {1: "prepare", 2: "commit_watermark", 3: "head_commit_range", 4: "upstream_confirm"}
KINDS = {1: "put", 2: "delete"}
#: Type, kind, two bytes of nothing, slot, chain version, sequence, object version, created, updated (ns), confirmed sequence, lengths of key and value.
HEAD = struct.Struct("<BB2xQQQQQQQII")
#: Records that are parsed at once.
ROWS = 10_000
_COLUMNS = ["type", "slot", "chain_version", "sequence", "kind", "key", "value", "upstream_confirmed_sequence"]
SCHEMA = "file string, at bigint, type string, slot bigint, chain_version bigint, sequence bigint, kind string, key string, value string, upstream_confirmed_sequence bigint"


def binary_records(raw: bytes | BinaryIO) -> Iterator[dict]:
    """Records up to the first that is cut off, which ends the journal."""
    src = io.BytesIO(raw) if isinstance(raw, bytes) else raw
    while len(head := src.read(HEAD.size)) == HEAD.size:
        type_, kind, slot, chain, sequence, _, _, _, confirmed, n_key, n_value = HEAD.unpack(head)
        if len(body := src.read(n_key + n_value)) < n_key + n_value:
            return
        yield dict(zip(_COLUMNS, (TYPES.get(type_, ""), slot, chain, sequence, KINDS.get(kind, ""), body[:n_key].decode("utf-8", "replace"), body[n_key:].decode("utf-8", "replace"), confirmed)))


def json_records(raw: bytes | BinaryIO) -> Iterator[dict]:
    """Records up to the first that is cut off; one that is whole but no JSON is an error."""
    src = io.BytesIO(raw) if isinstance(raw, bytes) else raw
    while len(head := src.read(4)) == 4:
        (n,) = struct.unpack("<I", head)
        if len(body := src.read(n)) < n:
            return
        r = json.loads(body)
        yield {c: r.get(c, 0 if c in ("slot", "chain_version", "sequence", "upstream_confirmed_sequence") else "") for c in _COLUMNS}


def encode_binary(r: dict) -> bytes:
    key, value = (r.get(c) or "" for c in ("key", "value"))
    code = lambda names, x: next((k for k, v in names.items() if v == x), 0)
    return HEAD.pack(code(TYPES, r["type"]), code(KINDS, r.get("kind")), r["slot"], r["chain_version"], r["sequence"], 0, 0, 0, r.get("upstream_confirmed_sequence") or 0, len(key.encode()), len(value.encode())) + key.encode() + value.encode()


def encode_json(r: dict) -> bytes:
    raw = json.dumps({k: v for k, v in r.items() if v not in (None, "")}).encode()
    return struct.pack("<I", len(raw)) + raw


def _batch(rows: tuple[tuple[str, int, dict], ...]) -> pa.RecordBatch:
    cols = [pa.array([path for path, _, _ in rows], pa.string()), pa.array([at for _, at, _ in rows], pa.int64())]
    cols += [pa.array([r[c] for _, _, r in rows], pa.int64() if c in ("slot", "chain_version", "sequence", "upstream_confirmed_sequence") else pa.string()) for c in _COLUMNS]
    return pa.RecordBatch.from_arrays(cols, names=["file", "at", *_COLUMNS])


def _parsed(batches: Iterator[pa.RecordBatch], parse) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            for rows in batched(((path, at, r) for at, r in enumerate(parse(content.as_py()))), ROWS):
                yield _batch(rows)


def _streamed(batches: Iterator[pa.RecordBatch], base: str, parse) -> Iterator[pa.RecordBatch]:
    fs, root = _open(base)

    def found() -> Iterator[tuple[str, int, dict]]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with fs.open_input_stream(f"{root}/{path}", compression=None) as raw, io.BufferedReader(raw, 1 << 16) as src:
                    for at, r in enumerate(parse(src)):
                        yield f"{base}/{path}", at, r

    for rows in batched(found(), ROWS):
        yield _batch(rows)


def journal(spark: SparkSession, path: str, binary: bool = True) -> DataFrame:
    """(file, at, record) of a journal file, or of the .log segments of a folder: a segment a row, so they are read side by side.

    Records come in order of (file, at), for segments are named in order.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(path).select("path", "content")
    parse = binary_records if binary else json_records
    return found.mapInArrow(lambda it: _parsed(it, parse), SCHEMA)


def journal_of(files: DataFrame, base: str, binary: bool = True) -> DataFrame:
    """(file, at, record), as journal gives them, of the segments of a manifest below ``base``, which may be very many.

    Tasks open segments by name and read them record by record: neither a row
    nor a batch holds a segment, and the driver lists none.
    """
    parse = binary_records if binary else json_records
    return dealt(files).mapInArrow(lambda it: _streamed(it, base, parse), SCHEMA)


def segments(records: DataFrame, segment: str, order: str, binary: bool = True) -> DataFrame:
    """(path, content, last), a row a record, of journal segments from records (slot, type, sequence, ...).

    Those of a segment follow each other in order in one task, so put_files
    makes a file of them, and no row or batch holds segments.
    """
    encode = encode_binary if binary else encode_json

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [encode(r) for r in batch.column("record").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(held, pa.binary()), batch.column("last")], names=["path", "content", "last"])

    cols = [c for c in _COLUMNS if c in records.columns]
    held = records.withColumn("path", F.format_string("segment-%08d.log", F.col(segment).cast("int"))).withColumn("o", F.struct(order, *cols))
    held = held.repartition("path").withColumn("last", F.lead("o").over(W.partitionBy("path").orderBy("o")).isNull()).sortWithinPartitions("path", "o")
    return held.select("path", F.struct(*cols).alias("record"), "last").mapInArrow(packed, "path string, content binary, last boolean")
