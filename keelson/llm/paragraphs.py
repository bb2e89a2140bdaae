"""Substring dedup: MinHash banding of paragraphs, exact verification, removal by components.

Paragraphs are, first, lines of LEAST words or more. They have a MinHash
signature of their five-word shingles, banded for high recall (ten bands of
three: a pair at the threshold is missed one time in 1,300). Paragraphs that
collide in a band are joined, verified by exact Jaccard, and linked into
components.

A passage may also lie anywhere in the words of a text, within or across
lines. So every LEAST words in a row are a paragraph too (a gram). Two of them
that differ inside share too few shingles to be alike, so grams are alike where
they are equal, and one band of one row finds all of these: the least hash of
the eight-word shingles in a gram (its anchor), which its neighbours mostly
share. Grams whose anchor several rows have are verified themselves, each of
them, and those that several rows have make up the repeated runs.

Texts are read once, into batches of word hashes in the shared folder. A batch
asks the owners of its keys (of lines, anchors, bands and grams) which of them
other rows have. It asks for a key once, however many of its rows have it, so a
passage that a third of all rows share is a few rows at its owner.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from keelson.llm.common import shared_dir, written
from keelson.llm.components import components
from keelson.llm.files import ROW, as_bytes, as_table, by_batch, by_shard, groups, load_compressed, pack, rows_of, save, shard_of, squeeze, stretches, unpack, widen

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 10, 3
#: Words of a paragraph, and of a repeated run, that count as a passage; words of a shingle of anchors.
LEAST, ANCHOR = 20, 8
#: Words of a batch, bytes of text for each shard of keys, and rows that a task hands on at once.
HELD, SHARD_BYTES, HANDED = 1_000_000, 16_000_000, 20_000
#: Paragraphs of a band compared in one piece, on average; larger buckets are dealt out in pairs of blocks.
BLOCK = 256
#: The number of a row has its partition above, and its place there in so many bits.
PART_BITS = 33
_LARGEST = (1 << 63) - 1

_RNG = np.random.default_rng(5)
_A = (_RNG.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RNG.integers(0, 1 << 62, BANDS * ROWS, dtype=np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


# --- hashes -------------------------------------------------------------------------------------


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        out = (out ^ h[k : k + n]) * _MIX[k]
        out ^= out >> np.uint64(29)
    return out


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of five consecutive words each; of all words together, if there are fewer."""
    return _rolled(h, SHINGLE)


def signatures(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For paragraphs of ``sizes`` words each (SHINGLE at least), whose words' hashes come one after the other: a number a band."""
    if not len(sizes):
        return np.zeros((0, BANDS), np.uint64)
    ends = np.cumsum(sizes)
    inside = np.ones(len(h), bool)
    for k in range(1, SHINGLE):
        inside[ends - k] = False  # these would run into the next paragraph
    s = _rolled(np.concatenate((h, np.zeros(SHINGLE - 1, np.uint64))), SHINGLE)[inside]
    starts = np.cumsum(sizes - SHINGLE + 1) - (sizes - SHINGLE + 1)
    least = np.full((len(sizes), BANDS * ROWS), np.uint64(0xFFFFFFFFFFFFFFFF))
    step, first = 16_384, 0
    for at in range(0, len(s), step):
        x = s[at : at + step, None] * _A + _B
        x ^= x >> np.uint64(32)
        last = int(np.searchsorted(starts, at + step))
        cut_at = np.maximum(starts[first:last], at) - at
        least[first:last] = np.minimum(least[first:last], np.minimum.reduceat(x, cut_at, axis=0))
        first = last if last < len(starts) and starts[last] == at + step else last - 1
    rows = least.reshape(-1, BANDS, ROWS)
    out = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], len(sizes), axis=0)
    for k in range(ROWS):
        out = (out ^ rows[:, :, k]) * _MIX[k]
        out ^= out >> np.uint64(31)
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _MIX[0] + (b ^ (b >> np.uint64(32))) * _MIX[1]
    x = (x ^ (x >> np.uint64(29))) * _MIX[2]
    return x ^ (x >> np.uint64(32))


def anchored(h: np.ndarray, of_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of ``of_text`` words, whose hashes come one after the other: where grams begin, their anchors, and the grams themselves."""
    if len(h) < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    four = _rolled(h, 4)
    eight = _pair(four[:-4], four[4:])
    n = len(h) - LEAST + 1
    at = np.flatnonzero(np.repeat(np.cumsum(of_text), of_text)[:n] - np.arange(n) >= LEAST)
    width, least = 1, eight
    while 2 * width <= LEAST - ANCHOR + 1:  # least of twice as many each time
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    rest = LEAST - ANCHOR + 1 - width
    least = np.minimum(least[: len(least) - rest], least[rest:])
    grams = _pair(_pair(eight[:n], eight[8 : 8 + n]), four[16 : 16 + n])
    return at, least[at], grams[at]


def line_keys(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of the words of each line, from those of all lines, one after the other."""
    begins = np.cumsum(sizes) - sizes
    power = np.cumprod(np.full(int(sizes.max(initial=0)), _MIX[4]), dtype=np.uint64)
    place = np.arange(len(h)) - np.repeat(begins, sizes)
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[place], dtype=np.uint64)))
    x = (upto[begins + sizes] - upto[begins] + sizes.astype(np.uint64)) * _MIX[0]
    x = (x ^ (x >> np.uint64(31))) * _MIX[3]
    return x ^ (x >> np.uint64(30))


# --- batches of texts ---------------------------------------------------------------------------


def _grouped(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, whether several rows have each, and the place of each entry's key; rows ascend."""
    order = np.argsort(key, kind="stable")
    k, r = key[order], row[order]
    new = np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1]))
    at = np.flatnonzero(new)
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    last = np.append(at[1:], len(k))[: len(at)] - 1
    return k[at], r[at] != r[last], place


class Batch:
    """Texts one after the other: their lines, the hashes of their words, and what follows from these."""

    def __init__(self, arrays: list[np.ndarray]):
        (self.first,), sizes, lines, stream, hashes, self.ord, docs = arrays
        self.sizes, self.lines = widen(sizes), widen(lines)
        self.h, self._docs = hashes[widen(stream)], docs
        ends = np.concatenate(([0], np.cumsum(self.sizes)))
        line_ends = np.cumsum(self.lines)
        self.text_of_line = np.repeat(np.arange(len(self.lines)), self.lines)
        self.line_in_text = np.arange(len(self.sizes)) - (line_ends - self.lines)[self.text_of_line]
        self.words = ends[line_ends] - ends[line_ends - self.lines]  # of each text
        self.begin = ends[line_ends - self.lines]
        self.long = np.flatnonzero(self.sizes >= LEAST)
        keys = line_keys(self.h, self.sizes)[self.long]
        self.keys, self.key_several, self.key_of = _grouped(keys, self.text_of_line[self.long])
        self.p, anchors, self.grams = anchored(self.h, self.words)
        self.text = np.searchsorted(self.begin, self.p, side="right") - 1  # texts without words begin where the next does
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(anchors)), bool), (anchors[1:] != anchors[:-1]) | (self.text[1:] != self.text[:-1]))))
        self.anchors, self.anchor_several, of = _grouped(anchors[new], self.text[new])
        self.anchor_of = np.repeat(of, np.diff(new, append=len(anchors)))

    @property
    def docs(self) -> pa.Array:
        return as_table(self._docs)["doc_id"].combine_chunks()

    def asked(self, keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys by shard, and their shards."""
        shard = shard_of(keys, shards).astype(np.uint32)
        order = np.argsort(shard, kind="stable")
        return order, shard[order]

    def home_lines(self, own: np.ndarray) -> np.ndarray:
        """Places, among the long lines, of the first ones here that have a key which ``own`` marks."""
        _, first = np.unique(self.key_of, return_index=True)
        return first[own]

    def kept_grams(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of grams with a shared anchor: their places; of distinct ones the first, by ord and place; whether several rows have it; and each one's distinct one."""
        at = np.flatnonzero(shared[self.anchor_of])
        rank = np.empty(len(self.ord), np.int64)
        rank[np.lexsort((np.arange(len(self.ord)), self.ord))] = np.arange(len(self.ord))
        g, t = self.grams[at], self.text[at]
        order = np.lexsort((at, rank[t], g))
        new = np.concatenate((np.ones(min(1, len(g)), bool), g[order][1:] != g[order][:-1]))
        of = np.empty(len(g), np.int64)
        of[order] = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(g))[: len(begin)] - 1
        several = t[order[begin]] != t[order[last]]
        first = order[begin]
        # by place, so that neighbours in a text stay together
        by_place = np.argsort(first)
        where = np.empty(len(first), np.int64)
        where[by_place] = np.arange(len(first))
        return at, at[first[by_place]], several[by_place], where[of]


class _Reader:
    def __init__(self, name: str, first: int) -> None:
        self.name, self.first = name, first
        self.number: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.parts: list[np.ndarray] = []
        self.sizes: list[list[int]] = []
        self.docs: list[pa.Table] = []
        self.words = 0

    def add(self, text: str | None) -> None:
        lines = [line.split() for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]
        sizes = list(map(len, lines))
        n = sum(sizes)
        self.parts.append(np.fromiter(map(self.number.__getitem__, chain.from_iterable(lines)), np.int32, n))
        self.sizes.append(sizes)
        self.words += n + 1

    def close(self, folder: str) -> Batch:
        docs = pa.concat_tables(self.docs).combine_chunks()
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.number), np.uint64, len(self.number))
        lines = np.array([len(x) for x in self.sizes], np.int64)
        sizes = np.fromiter(chain.from_iterable(self.sizes), np.int64, int(lines.sum()))
        arrays = [np.array([self.first], np.int64), squeeze(sizes), squeeze(lines), squeeze(np.concatenate(self.parts)), hashes, docs["ord"].to_numpy().astype(np.int64), as_bytes(docs.select(["doc_id"]))]
        save(f"{folder}/batch-{self.name}", arrays, compressed=True)
        return Batch(arrays)


#: Questions of the two rounds go to shard 2 s + kind.
_LINES, _ANCHORS = 0, 1
_BANDS, _GRAMS = 0, 1


def read_texts(batches: Iterator[pa.RecordBatch], folder: str, shards: int) -> Iterator[pa.RecordBatch]:
    """Questions about lines and anchors of rows (doc_id, ord, text)."""
    part, names, row = TaskContext.get().partitionId(), count(), 0
    new = lambda: _Reader(f"{part}-{next(names)}", (part << PART_BITS) + row)

    def close(held: _Reader) -> pa.RecordBatch:
        b, out = held.close(folder), []
        order, shard = b.asked(b.keys, shards)
        rows = b.text_of_line[b.long[b.home_lines(np.ones(len(b.keys), bool))]]
        for s, at in stretches(shard):
            k = order[at]
            out.append((held.name, 2 * s + _LINES, pack([b.keys[k], np.array([b.first], np.int64), squeeze(rows[k]), np.packbits(b.key_several[k])])))
        order, shard = b.asked(b.anchors, shards)
        for s, at in stretches(shard):
            k = order[at]
            out.append((held.name, 2 * s + _ANCHORS, pack([b.anchors[k], np.packbits(b.anchor_several[k])])))
        # a row that makes sure that the batch goes on, even without a key
        out.append((held.name, 2 * (part % shards), None))
        return rows_of(out)

    held = new()
    for rows in batches:
        docs, first = pa.Table.from_batches([rows.select(["doc_id", "ord"])]), 0
        for i, text in enumerate(rows.column("text")):
            held.add(text.as_py())
            row += 1
            if held.words >= HELD:
                held.docs.append(docs.slice(first, i + 1 - first))
                yield close(held)
                held, first = new(), i + 1
        held.docs.append(docs.slice(first))
    if held.words:
        yield close(held)


# --- owners of keys -----------------------------------------------------------------------------


def _bools(packed: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(packed, count=n).astype(bool)


def _answers(shard: int, rows: list[tuple], sizes: list[int], *found: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each batch's own part of the flags, and then of the numbers where the first flag holds."""
    ends = np.cumsum(sizes)
    for (batch, _), a, z in zip(rows, ends - sizes, ends):
        flags = [x[a:z] for x in found if x.dtype == bool]
        numbers = [squeeze(x[a:z][flags[0]]) for x in found if x.dtype != bool]
        yield rows_of([(batch, shard, pack([np.array([z - a], np.int64), *map(np.packbits, flags), *numbers]))])


def _by_key(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of entries by key, then by the other columns; where keys begin in it; and entries of each key."""
    order = np.lexsort(columns[::-1])
    key = columns[0][order]
    begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    return order, begin, np.diff(begin, append=len(key))


def _spread(order: np.ndarray, size: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The value of each entry's key."""
    out = np.empty(len(order), value.dtype)
    out[order] = np.repeat(value, size)
    return out


def _any(order: np.ndarray, begin: np.ndarray, flag: np.ndarray) -> np.ndarray:
    return np.logical_or.reduceat(flag[order], begin) if len(begin) else np.zeros(0, bool)


def own_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of lines: whether this batch has the first, and whether several rows have it; of anchors: whether several rows have it."""
    for shard, rows in groups(batches, "shard"):
        yield rows_of([(batch, shard, None) for batch, block in rows if block is None])
        rows = [(batch, unpack(block)) for batch, block in rows if block]
        if not rows:
            continue
        sizes = [len(b[0]) for _, b in rows]
        flag = np.concatenate([_bools(b[-1], n) for (_, b), n in zip(rows, sizes)])
        keys = np.concatenate([b[0] for _, b in rows])
        if shard % 2 == _ANCHORS:
            order, begin, size = _by_key(keys)
            yield from _answers(shard, rows, sizes, _spread(order, size, (size > 1) | _any(order, begin, flag)))
        else:
            rid = np.concatenate([b[1][0] + widen(b[2]) for _, b in rows])
            order, begin, size = _by_key(keys, rid)
            home = _spread(order, size, rid[order[begin]]) == rid
            yield from _answers(shard, rows, sizes, home, _spread(order, size, (size > 1) | _any(order, begin, flag)))


def own_second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of bands: whether several paragraphs have it, and how many; of grams: whether several rows have it, and row and place of the first."""
    for shard, rows in groups(batches, "shard"):
        yield rows_of([(batch, shard, None) for batch, block in rows if block is None])
        rows = [(batch, unpack(block)) for batch, block in rows if block]
        if not rows:
            continue
        sizes = [len(b[0]) for _, b in rows]
        keys = np.concatenate([b[0] for _, b in rows])
        if shard % 2 == _BANDS:
            n = np.concatenate([widen(b[1]) for _, b in rows])
            order, begin, size = _by_key(keys)
            total = _spread(order, size, np.add.reduceat(n[order], begin) if len(begin) else n)
            yield from _answers(shard, rows, sizes, total > 1, total)
        else:
            flag = np.concatenate([_bools(b[-1], n) for (_, b), n in zip(rows, sizes)])
            text = [np.repeat(np.cumsum(widen(b[2])), widen(b[3])) for _, b in rows]
            rid = np.concatenate([b[1][0] + t for t, (_, b) in zip(text, rows)])
            ord_ = np.concatenate([np.repeat(b[5], widen(b[3])) for _, b in rows])
            place = np.concatenate([widen(b[4]) for _, b in rows])
            order, begin, size = _by_key(keys, ord_, rid, place)
            several = (size > 1) | _any(order, begin, flag)
            first = order[begin]
            yield from _answers(shard, rows, sizes, *(_spread(order, size, x) for x in (several, rid[first], place[first])))


# --- what batches make of the answers -----------------------------------------------------------


class Told:
    """A batch and what it was told of its keys, in the order in which it has them."""

    def __init__(self, folder: str, batch: str, rows: list[tuple]):
        self.b = Batch(load_compressed(f"{folder}/batch-{batch}"))
        self.rows = [(shard, unpack(block)) for shard, block in rows if block]

    def flags(self, kind: int, keys: np.ndarray, shards: int, n_flags: int = 1, n_numbers: int = 0) -> list[np.ndarray]:
        """Flags of all keys, and the numbers of those whose first flag holds."""
        mine = [b for shard, b in self.rows if shard % 2 == kind]
        order, _ = self.b.asked(keys, shards)
        out = []
        for i in range(n_flags):
            x = np.zeros(len(keys), bool)
            x[order] = np.concatenate([_bools(b[1 + i], int(b[0][0])) for b in mine]) if mine else False
            out.append(x)
        at = order[out[0][order]]
        for i in range(n_numbers):
            x = np.zeros(len(keys), np.int64)
            x[at] = np.concatenate([widen(b[1 + n_flags + i]) for b in mine]) if mine else 0
            out.append(x)
        return out


def ask_second(batches: Iterator[pa.RecordBatch], folder: str, shards: int) -> Iterator[pa.RecordBatch]:
    """Questions about the bands of lines that are first here, and about grams of shared anchors."""
    for batch, rows in groups(batches, "batch"):
        told = Told(folder, batch, rows)
        b = told.b
        own, several = told.flags(_LINES, b.keys, shards, 2)
        (shared,) = told.flags(_ANCHORS, b.anchors, shards)
        save(f"{folder}/told-{batch}", [own, several, shared], compressed=True)
        bands, n = np.unique(bands_of(b, own), return_counts=True)
        order, shard = b.asked(bands, shards)
        out = []
        for s, at in stretches(shard):
            k = order[at]
            out.append((batch, 2 * s + _BANDS, pack([bands[k], squeeze(n[k])])))
        _, first, several, _ = b.kept_grams(shared)
        order, shard = b.asked(b.grams[first], shards)
        for s, at in stretches(shard):
            k = order[at]
            w = first[k]
            t = b.text[w]
            new = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            texts = t[new]
            place = b.p[w] - b.begin[t]
            arrays = [b.grams[w], np.array([b.first], np.int64), squeeze(np.diff(texts, prepend=0)), squeeze(np.diff(new, append=len(t))), squeeze(place), b.ord[texts], np.packbits(several[k])]
            out.append((batch, 2 * s + _GRAMS, pack(arrays)))
        out.append((batch, 2 * (b.first % shards), None))
        yield rows_of(out)


def bands_of(b: Batch, own: np.ndarray) -> np.ndarray:
    """Bands of the lines that are first here, one row each."""
    lines = b.long[b.home_lines(own)]
    inside = np.zeros(len(b.sizes), bool)
    inside[lines] = True
    order = np.argsort(lines)
    out = np.empty((len(lines), BANDS), np.uint64)
    out[order] = signatures(b.h[np.repeat(inside, b.sizes)], b.sizes[lines[order]])
    return out


def spans_of(runs: list[tuple[int, int, int, int, int]], own: int, sizes: np.ndarray) -> tuple[list[tuple], list[tuple]]:
    """Of a row, from its stretches (first, n, home_rid, home_first, gram) by first: spans (line, first word, end word, removed, stretch) and homes (first, end, gram).

    Of a gram the row that has it first keeps its first place; words of all
    other places go, but not those that a row's own first places have too.
    """
    words = int(sizes.sum())
    foreign, kept, again = (np.full(words, -1) for _ in range(3))
    for i, (first, n, home, home_first, _) in reversed(list(enumerate(runs))):
        (foreign if home != own else kept if home_first == first else again)[first : first + n + LEAST - 1] = i
    label = np.where(foreign >= 0, foreign, np.where(kept >= 0, kept, again))
    gone = (foreign >= 0) | ((kept < 0) & (again >= 0))
    line = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.cumsum(sizes) - sizes
    edges = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (gone[1:] != gone[:-1]) | (line[1:] != line[:-1]))))
    out = []
    for a, z in zip(edges.tolist(), [*edges[1:].tolist(), words]):
        if label[a] >= 0:
            k = int(line[a])
            out.append((k, a - int(begins[k]), z - int(begins[k]), bool(gone[a]), int(label[a])))
    return out, [(first, first + n, gram) for first, n, home, home_first, gram in runs if home == own and home_first == first]


#: Kinds of rows that a batch makes: spans of runs; stretches of runs that are first; whole lines that others may be like; lines to be verified.
SPAN, HOME, LINE, CANDIDATE = range(4)
_NUMBERS = {"kind": pa.int32(), "rid": pa.int64(), "line": pa.int32(), "first": pa.int32(), "end": pa.int32(), "home_rid": pa.int64(), "home_first": pa.int32(), "key": pa.int64(), "band": pa.int64(), "part": pa.int64()}


def find(batches: Iterator[pa.RecordBatch], folder: str, shards: int, block: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """All rows of each batch, by kind, from the answers about its bands and grams."""

    def made(docs: pa.Array, n: int, kind: int, text: np.ndarray | None = None, removed: np.ndarray | None = None, sets: list[bytes] | None = None, **numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
        numbers["kind"] = np.full(n, kind)
        given = {c: pa.array(numbers[c], t) if c in numbers else pa.nulls(n, t) for c, t in _NUMBERS.items()}
        given["doc_id"] = docs.take(pa.array(text)) if text is not None else pa.nulls(n, docs.type)
        given["removed"] = pa.array(removed, pa.bool_()) if removed is not None else pa.nulls(n, pa.bool_())
        given["shingles"] = pa.array(sets, pa.binary()) if sets is not None else pa.nulls(n, pa.binary())
        table = pa.RecordBatch.from_arrays([given[f.name].cast(f.type) for f in schema], schema=schema)
        for at in range(0, n, HANDED):
            yield table.slice(at, HANDED)

    for batch, rows in groups(batches, "batch"):
        told = Told(folder, batch, rows)
        b, docs = told.b, told.b.docs
        own, several, shared = load_compressed(f"{folder}/told-{batch}")
        # lines
        bands = bands_of(b, own)
        distinct, of = np.unique(bands, return_inverse=True)
        hit, n = told.flags(_BANDS, distinct, shards, 1, 1)
        of = of.reshape(bands.shape)
        lines = b.home_lines(own)
        candidate = hit[of].any(axis=1)
        near = np.zeros(len(b.keys), bool)
        near[b.key_of[lines[candidate]]] = True
        member = (several | near)[b.key_of]
        at = b.long[member]
        text = b.text_of_line[at]
        yield from made(docs, len(at), LINE, text, rid=b.first + text, line=b.line_in_text[at], end=b.sizes[at], key=b.keys[b.key_of[member]].view(np.int64))
        begins = np.cumsum(b.sizes) - b.sizes
        out: dict[str, list] = {"key": [], "band": [], "part": [], "sets": []}
        for i in np.flatnonzero(candidate).tolist():
            line = b.long[lines[i]]
            key = b.keys[b.key_of[lines[i]]]
            s = np.unique(shingles(b.h[begins[line] : begins[line] + b.sizes[line]])).tobytes()
            for k in of[i][hit[of[i]]].tolist():
                blocks = -(-int(n[k]) // block)
                me = int(key) % blocks
                for other in range(blocks):
                    for c, x in zip(out, (key.astype(np.int64), distinct[k].astype(np.int64), min(me, other) * blocks + max(me, other), s)):
                        out[c].append(x)
            if len(out["key"]) >= HANDED:
                yield from made(docs, len(out["key"]), CANDIDATE, **out)
                out = {c: [] for c in out}
        yield from made(docs, len(out["key"]), CANDIDATE, **out)
        # runs
        at, first, _, of = b.kept_grams(shared)
        hit, home_rid, home_first = told.flags(_GRAMS, b.grams[first], shards, 1, 2)
        mine = hit[of]
        at, of = at[mine], of[mine]
        text, home, place = b.text[at], home_rid[of], home_first[of]
        p = b.p[at] - b.begin[text]
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(p)), bool), (text[1:] != text[:-1]) | (p[1:] != p[:-1] + 1) | (home[1:] != home[:-1]) | (place[1:] != place[:-1] + 1))))
        size = np.diff(new, append=len(p))
        gram = b.grams[at].view(np.int64)
        line_ends = np.cumsum(b.lines)
        spans: list[tuple] = []
        homes: list[tuple] = []
        for t, cut_ in stretches(text[new]):
            k = new[cut_]
            runs = list(zip(p[k].tolist(), size[cut_].tolist(), home[k].tolist(), place[k].tolist(), gram[k].tolist()))
            found, firsts = spans_of(runs, int(b.first) + t, b.sizes[line_ends[t] - b.lines[t] : line_ends[t]])
            spans += [(t, line, a, z, gone, runs[i][2], runs[i][3]) for line, a, z, gone, i in found]
            homes += [(t, *x) for x in firsts]
        col = lambda rows, i: np.array([r[i] for r in rows], np.int64)
        yield from made(docs, len(spans), SPAN, col(spans, 0), col(spans, 4).astype(bool), rid=b.first + col(spans, 0), line=col(spans, 1), first=col(spans, 2), end=col(spans, 3), home_rid=col(spans, 5), home_first=col(spans, 6))
        yield from made(docs, len(homes), HOME, col(homes, 0), rid=b.first + col(homes, 0), first=col(homes, 1), end=col(homes, 2), key=col(homes, 3))


def _alike(sets: list[np.ndarray]) -> np.ndarray:
    """Whether each two sets have a Jaccard similarity of SIMILARITY or more, by blocks of their incidence matrix."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for a in range(0, int(at[-1]) + 1, width):
        lo, hi = np.searchsorted(at, (a, a + width))
        x = np.zeros((len(sets), width), np.float32)
        x[owner[lo:hi], at[lo:hi] - a] = 1
        both += x @ x.T
    return both >= SIMILARITY * (sizes[:, None] + sizes[None, :] - both) - 1e-3


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) within the groups of rows (band, part, key, shingles) sorted by group: a spanning forest of each."""

    def forest(keys: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        if len(keys) < 2:
            return
        near, root = _alike(sets), np.arange(len(keys))
        while True:
            least = np.where(near, root[None, :], len(keys)).min(axis=1)
            least = np.minimum(root, least)[np.minimum(root, least)]
            if (least == root).all():
                break
            root = least
        for i in np.flatnonzero(root != np.arange(len(keys))):
            yield keys[i], keys[root[i]]

    now, keys, sets = None, [], []
    for batch in batches:
        out: list[tuple[int, int]] = []
        for group, key, s in zip(zip(batch.column("band").to_pylist(), batch.column("part").to_pylist()), batch.column("key").to_pylist(), batch.column("shingles")):
            if group != now:
                out += forest(keys, sets)
                now, keys, sets = group, [], []
            keys.append(key)
            sets.append(np.frombuffer(s.as_py(), np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
    out = list(forest(keys, sets))
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


# --- the operator -------------------------------------------------------------------------------


def _found(docs: DataFrame, doc_id: str, text: str, block: int) -> DataFrame:
    """Rows of all kinds, of all batches."""
    kind = docs.schema[doc_id].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_LARGEST)) if whole else F.lit(0).cast("bigint")).alias("ord"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD_BYTES))
    folder = shared_dir(docs.sparkSession, "batches")
    told = by_shard(rows.mapInArrow(lambda it: read_texts(it, folder, shards), ROW), 2 * shards).mapInArrow(own_first, ROW)
    told = by_shard(by_batch(told, size).mapInArrow(lambda it: ask_second(it, folder, shards), ROW), 2 * shards).mapInArrow(own_second, ROW)
    types = {"kind": T.IntegerType(), "rid": T.LongType(), "doc_id": kind, "line": T.IntegerType(), "first": T.IntegerType(), "end": T.IntegerType(), "removed": T.BooleanType(), "home_rid": T.LongType()}
    types |= {"home_first": T.IntegerType(), "key": T.LongType(), "band": T.LongType(), "part": T.LongType(), "shingles": T.BinaryType()}
    schema = T.StructType([T.StructField(c, t) for c, t in types.items()])
    arrow = to_arrow_schema(schema)
    return written(by_batch(told, size).mapInArrow(lambda it: find(it, folder, shards, block, arrow), schema), "found", "zstd")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(rid, doc_id, line, first_word, end_word, n_words, class_key, class_doc_id, removed, whole): each passage that other rows have too.

    Whole passages are lines of LEAST words or more; of a component of them the
    first stays, by doc_id (nulls last), row and line, and the others have
    removed true. The others are the words of all verbatim runs of LEAST words
    or more that several rows have, wherever they lie, line by line; the first
    row of a run, in the same order, keeps it (by row alone, if ids are no
    whole numbers). class_doc_id is the document of the one that stays. Words
    are lower-cased runs between white space. Passages repeated within one row
    alone are not listed. Null and empty texts have no passages. rid numbers
    the rows of ``docs``, which must come in the same order if they are read
    again, as those of tables do; rows alike in all columns are copies of each
    other.
    """
    found = _found(docs, doc_id, text, block)
    of = lambda kind, *cols: found.where(F.col("kind") == kind).select(*cols)
    pairs = of(CANDIDATE, "band", "part", "key", "shingles").repartition("band", "part").sortWithinPartitions("band", "part")
    links = written(pairs.mapInArrow(_verified, "a bigint, b bigint"), "paragraph-links")
    roots = components(links, "a", "b").withColumnRenamed("node", "key")
    lines = of(LINE, "rid", "doc_id", "line", "end", "key").join(roots, "key", "left").withColumn("class_key", F.coalesce("root", "key")).drop("root", "key")
    lines = written(lines, "lines")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid", "line")
    # by itself, so that the join that follows has no part in it and its hot keys can be split
    start = written(lines.groupBy("class_key").agg(F.min(place).alias("start"), F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo <> hi").select("class_key", "start"), "starts")
    each = lines.join(start, "class_key").withColumn("removed", ~place.eqNullSafe(F.col("start")))
    whole = each.select("rid", "doc_id", "line", F.lit(0).alias("first"), "end", "class_key", F.col("start.doc_id").alias("class_doc_id"), "removed", F.lit(True).alias("whole"))
    homes = of(HOME, F.col("rid").alias("home_rid"), F.col("doc_id").alias("class_doc_id"), F.col("first").alias("from"), F.col("end").alias("to"), F.col("key").alias("class_key"))
    spans = of(SPAN, "rid", "doc_id", "line", "first", "end", "removed", "home_rid", "home_first").join(homes, "home_rid").where("home_first >= from and home_first < to")
    runs = spans.select("rid", "doc_id", "line", "first", "end", "class_key", "class_doc_id", "removed", F.lit(False).alias("whole"))
    out = whole.unionByName(runs)
    return out.select("rid", "doc_id", "line", F.col("first").alias("first_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("first")).alias("n_words"), F.lower(F.lpad(F.hex("class_key"), 16, "0")).alias("class_key"), "class_doc_id", "removed", "whole")


def cut(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` without the (line, first word, end word) spans; a line left without words goes."""
    by_line: dict[int, list[tuple[int, int]]] = {}
    for k, a, z in spans:
        by_line.setdefault(k, []).append((a, z))
    out = []
    for k, line in enumerate(text.split("\n")):
        if k in by_line:
            words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0d]+", line)]
            gone = {i for a, z in by_line[k] for i in range(a, z)}
            left = [line[a:z] for i, (a, z) in enumerate(words) if i not in gone]
            if not left:
                continue
            line = " ".join(left)
        out.append(line)
    return "\n".join(out)


def without_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the passages that ``repeats`` removes, every row and column kept; the first row of a passage keeps it."""
    cols = docs.columns
    held = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.monotonically_increasing_id().alias("own")), "rows")
    found = repeats(held.select(F.col("own").alias("id"), F.col(f"row.`{text}`").alias("text")), "id", "text")
    gone = found.where("removed").groupBy(F.col("doc_id").alias("own")).agg(F.collect_list(F.struct("line", "first_word", "end_word")).alias("gone"))

    @F.arrow_udf(T.StringType())
    def cut_of(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([cut(t.as_py(), [tuple(x.values()) for x in s.as_py()]) if s.is_valid else t.as_py() for t, s in zip(texts, spans)], pa.string())

    out = held.join(gone, "own", "left")
    fresh = F.when(F.col("gone").isNotNull(), cut_of(F.col(f"row.`{text}`"), F.col("gone"))).otherwise(F.col(f"row.`{text}`")).alias("fresh")
    return out.select("row", fresh).select(*[(F.col("fresh") if c == text else F.col(f"row.`{c}`")).alias(c) for c in cols])
