"""Arrays in files of the shared folder, written whole and mapped into memory where they are read; and rows of such blocks.

Batches of texts ask the owners of shards and are answered: rows (batch, shard,
block) are shuffled by shard, and their answers back by batch.
"""

from __future__ import annotations

import io
import mmap
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame

from keelson.llm.common import open_fs


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays in one block, each at a multiple of 8 bytes, behind a head of their types and lengths."""
    head = np.array([len(arrays)] + [x for a in arrays for x in (ord(a.dtype.char), len(a))], np.int64)
    out = io.BytesIO()
    for a in [head, *arrays]:
        raw = np.ascontiguousarray(a).tobytes()
        out.write(raw + b"\0" * (-len(raw) % 8))
    return out.getvalue()


def unpack(buf) -> list[np.ndarray]:
    n = int(np.frombuffer(buf, np.int64, 1)[0])
    head = np.frombuffer(buf, np.int64, 2 * n, 8).reshape(n, 2)
    at, out = 8 + 16 * n, []
    for kind, size in head.tolist():
        a = np.frombuffer(buf, np.dtype(chr(kind)), size, at)
        out.append(a)
        at += -(-a.nbytes // 8) * 8
    return out


def squeeze(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in as few whole bytes as the largest needs: that width, then all lowest bytes, all next ones, and so on."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(x, dtype=np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T
    return np.concatenate((np.array([width], np.uint8), np.ascontiguousarray(planes).ravel()))


def widen(raw: np.ndarray) -> np.ndarray:
    """The numbers that ``squeeze`` was given, as int64."""
    width = int(raw[0])
    out = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    out[:, :width] = raw[1:].reshape(width, -1).T
    return out.view(np.int64).ravel()


def write_file(uri: str, data: bytes) -> None:
    """Writes beside and moves into place: a task tried twice, or at once in two places, leaves whole files.

    Both tries write the same bytes, so it does not matter whose stay.
    """
    fs, path = open_fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(own, compression=None) as out:
        out.write(data)
    try:
        fs.move(own, path)
    except OSError:
        if fs.get_file_info(path).type != pafs.FileType.File:
            raise
        fs.delete_file(own)


def save(uri: str, arrays: list[np.ndarray], compressed: bool = False) -> None:
    data = pack(arrays)
    if compressed:
        data = len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)
    write_file(uri, data)


def load(uri: str) -> list[np.ndarray] | None:
    """Arrays of a file, mapped into memory in place, or from a store that cannot be mapped read into pages of its own; None if there is no such file."""
    fs, path = open_fs(uri)
    info = fs.get_file_info(path)
    if info.type != pafs.FileType.File:
        return None
    if isinstance(fs, pafs.LocalFileSystem):
        return unpack(np.memmap(path, np.uint8, "r"))
    pages, at = mmap.mmap(-1, max(1, info.size)), 0
    with fs.open_input_stream(path, compression=None) as src:
        while block := src.read(1 << 24):
            pages[at : at + len(block)] = block
            at += len(block)
    return unpack(pages)


def load_compressed(uri: str) -> list[np.ndarray]:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as src:
        size = int.from_bytes(src.read(8), "little")
        return unpack(pa.decompress(src.read(), size, "zstd", asbytes=True))


def remove_folder(uri: str) -> None:
    """Deletes a folder of this module's files, if it is there."""
    fs, path = open_fs(uri)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)


# --- rows of blocks -----------------------------------------------------------------------------

ROW = "batch string, shard int, block binary"
#: Bytes of text for each task that works on whole batches.
BATCH_BYTES = 8_000_000


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.binary()))], names=["batch", "shard", "block"])


def groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple]:
    """Each key and its (other, block) of rows sorted by the key; by is batch or shard."""
    other = "shard" if by == "batch" else "batch"
    now, held = None, []
    for rows in batches:
        for key, o, block in zip(rows.column(by).to_pylist(), rows.column(other).to_pylist(), rows.column("block")):
            if held and key != now:
                yield now, held
                held = []
            now = key
            held.append((o, block.as_py()))
    if held:
        yield now, held


def stretches(key: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Values and stretches of a sorted array."""
    cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
    for a, z in zip([0, *cuts.tolist()] if len(key) else [], [*cuts.tolist(), len(key)]):
        yield int(key[a]), slice(a, z)


def shard_of(a: np.ndarray, shards: int, b: np.ndarray | int = 0) -> np.ndarray:
    x = a.astype(np.uint64, copy=False) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def by_shard(rows: DataFrame, shards: int) -> DataFrame:
    """One task for each shard, its rows together."""
    return rows.repartitionById(shards, "shard").sortWithinPartitions("shard")


def by_batch(rows: DataFrame, size: int) -> DataFrame:
    """Tasks for batches of ``size`` bytes of text in all: their blocks are small, so a task's share must not follow from bytes shuffled."""
    return rows.repartition(max(1, -(-size // BATCH_BYTES)), "batch").sortWithinPartitions("batch", "shard")


def as_bytes(table: pa.Table) -> np.ndarray:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return np.frombuffer(sink.getvalue(), np.uint8)


def as_table(raw: np.ndarray) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(raw)).read_all().combine_chunks()
