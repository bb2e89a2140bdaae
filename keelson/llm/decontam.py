"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a run of documents as word numbers, with 0 between them and for words
that no benchmark item has. Its suffix array holds the suffixes that can carry a
match, ordered by prefix doubling. Every suffix of every benchmark item is
searched in it by bisection, all at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import open_fs, shared_dir, text_slices

WINDOW = 13
#: A document is contaminated if at least one word in this many is hit.
SHARE = 20
#: Items of a benchmark file read at once by a task; more items make more files, searched one after the other.
ITEMS_PER_FILE = 5_000
#: Characters of documents in a shard; a longer document makes a shard of its own.
SHARD_CHARS = 4_000_000

_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def words_of(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and any other character beyond ASCII, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Queries:
    """All suffixes of the items of one benchmark file, as word numbers from 1."""

    def __init__(self, item_ids: list[str], texts: list[str | None], window: int = WINDOW):
        self.ids: list[str] = item_ids
        self.number: dict[bytes, int] = {}
        items = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of(t)], np.int64) for t in texts]
        self.items = items
        sizes = [min(window, len(x)) for x in items]  # words of an item's windows; 0: it has none
        self.least = min((n for n in sizes if n), default=0)
        self.item = np.repeat(np.arange(len(items)), [len(x) - n + 1 if n else 0 for x, n in zip(items, sizes)])
        self.at = np.concatenate([np.arange(len(x) - n + 1) for x, n in zip(items, sizes) if n] or [np.zeros(0, np.int64)])
        self.size = np.array(sizes, np.int64)[self.item] if len(self.item) else np.zeros(0, np.int64)
        self.word = np.zeros((len(self.item), window), np.int64)
        for row, (i, a, n) in enumerate(zip(self.item, self.at, self.size)):
            self.word[row, :n] = items[i][a : a + n]


def suffix_array(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` ordered by the suffixes of ``words`` there, compared over ``depth`` words at least.

    Prefix doubling: ranks over 1, 2, 4 ... words, until all ranks differ or the
    depth is reached; suffixes equal over that depth stay in order of position.
    """
    if not len(starts):
        return starts
    rank = np.concatenate((words, [0]))
    n, k = len(words), 1
    while k < depth:
        after = np.minimum(np.arange(n) + k, n)
        live = np.flatnonzero(rank[:n])
        key = rank[live] * (int(rank.max()) + 1) + rank[after[live]]
        kinds, place = np.unique(key, return_inverse=True)
        rank[live] = place + 1
        k *= 2
        if len(kinds) == len(live):
            break
    return starts[np.argsort(rank[starts], kind="stable")]


def _bound(words: np.ndarray, order: np.ndarray, query: np.ndarray, size: np.ndarray, upper: bool) -> np.ndarray:
    """For each query the first place in ``order`` whose suffix is not below it (or is above it, if ``upper``)."""
    lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(order), np.int64)
    span = np.arange(query.shape[1])
    inside = span < size[:, None]
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        have = np.where(inside, words[order[np.minimum(mid, len(order) - 1)][:, None] + span], 0)
        differ = have != query
        first = differ.argmax(axis=1)
        rows = np.arange(len(query))
        below = have[rows, first] < query[rows, first]
        right = below | (upper & ~differ.any(axis=1))
        lo, hi = np.where(open_ & right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
    return lo


def search(docs: list[list[bytes]], q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, word in it, row of ``q``, words matched) of every occurrence of a window in a shard.

    Matches are extended to their longest, as far as document and item agree.
    """
    none = np.zeros(0, np.int64)
    get = q.number.get
    parts = [np.fromiter((get(w, 0) for w in d), np.int64, len(d)) for d in docs]
    first = np.cumsum([0, *(len(p) + 1 for p in parts)])
    words = np.concatenate([x for p in parts for x in (p, [0])] + [np.zeros(q.word.shape[1], np.int64)]).astype(np.int64)
    # words from each place up to the next foreign one; a suffix with fewer than the shortest window cannot match
    zeros = np.flatnonzero(words == 0)
    run = zeros[np.searchsorted(zeros, np.arange(len(words)))] - np.arange(len(words))
    starts = np.flatnonzero(run >= q.least) if q.least else none
    if not len(starts):
        return none, none, none, none
    order = suffix_array(words, starts, q.word.shape[1])
    lo = _bound(words, order, q.word, q.size, False)
    hi = _bound(words, order, q.word, q.size, True)
    n = hi - lo
    if not n.sum():
        return none, none, none, none
    row = np.repeat(np.arange(len(n)), n)
    place = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    doc = np.searchsorted(first, place, side="right") - 1
    return doc, place - first[doc], row, q.size[row]


def longest(docs: list[list[bytes]], q: Queries) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, word, item, word in it, words) of every longest verbatim match of a window or more."""
    doc, at, row, size = search(docs, q)
    if not len(doc):
        return
    item, begin = q.item[row], q.at[row]
    order = np.lexsort((at, at - begin, item, doc))  # matches along one diagonal of document and item
    doc, at, item, begin, size = (x[order] for x in (doc, at, item, begin, size))
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] - begin[1:] != at[:-1] - begin[:-1]) | (at[1:] != at[:-1] + 1)))
    heads = np.flatnonzero(new)
    tails = np.concatenate((heads[1:], [len(doc)])) - 1
    for h, t in zip(heads, tails):
        yield int(doc[h]), int(at[h]), int(item[h]), int(begin[h]), int(at[t] + size[t] - at[h])


@lru_cache(maxsize=2)
def _load(uri: str, window: int) -> Queries:
    fs, path = open_fs(uri)
    t = pq.read_table(path, filesystem=fs)
    return Queries([x or "" for x in t["item_id"].to_pylist()], t["text"].to_pylist(), window)


def benchmark_files(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> list[str]:
    """The benchmark as files of at most ITEMS_PER_FILE items in the shared folder; tasks read one at a time."""
    path = shared_dir(benchmark.sparkSession, "benchmark")
    benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text")).write.option("maxRecordsPerFile", ITEMS_PER_FILE).parquet(path)
    return sorted(benchmark.sparkSession.read.schema("item_id string, text string").parquet(path).inputFiles())


def hits(docs: list[str | None], files: list[str], window: int = WINDOW) -> list[tuple[int, int, int, str, bool]]:
    """(n_words, n_hit, n_items, items_sha256, contaminated) of each whole text of a shard."""
    words = [words_of(t) for t in docs]
    first = np.cumsum([0, *(len(w) + 1 for w in words)])
    edge = np.zeros(first[-1] + 1, np.int32)  # +1 where a match begins, -1 past its end
    found: list[set[str]] = [set() for _ in docs]
    for f in files:
        q = _load(f, window)
        doc, at, row, size = search(words, q)
        np.add.at(edge, first[doc] + at, 1)
        np.add.at(edge, first[doc] + at + size, -1)
        for d, i in set(zip(doc.tolist(), q.item[row].tolist())):
            found[d].add(q.ids[i])
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edge) > 0)))
    out = []
    for d, w in enumerate(words):
        n = int(covered[first[d] + len(w)] - covered[first[d]])
        out.append((len(w), n, len(found[d]), hashlib.sha256(",".join(sorted(found[d])).encode()).hexdigest(), n > 0 and SHARE * n >= len(w)))
    return out


HITS = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
_HITS_DDL = "struct<n_words: bigint, n_hit: bigint, n_items: bigint, items_sha256: string, contaminated: boolean>"


def hits_of(files: list[str], window: int = WINDOW):
    """Arrow UDF from a text column to the struct of ``hits``."""

    @F.arrow_udf(_HITS_DDL)
    def scan(text: pa.Array) -> pa.Array:
        out: list = []
        for _, texts in text_slices(text, SHARD_CHARS):
            out += [dict(zip(HITS.names, r)) for r in hits(texts, files, window)]
        return pa.array(out, HITS)

    return scan


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``.

    A window is ``window`` consecutive words of an item, or the whole of a
    shorter item with words. Null and empty texts have no words and no hits;
    an empty benchmark hits nothing. Item ids are compared as text, repeated
    ids count once, a null id counts as the empty id. Nothing is shuffled: each
    task scans its own documents, one benchmark file after the other.
    """
    scan = hits_of(benchmark_files(benchmark), window)
    return docs.select(F.col(doc_id).alias("doc_id"), scan(F.col(text)).alias("h")).select("doc_id", "h.*")


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words): every longest verbatim match of a window or more."""
    files = benchmark_files(benchmark)
    kind = "array<struct<item_id: string, doc_word: bigint, item_word: bigint, n_words: bigint>>"

    @F.arrow_udf(kind)
    def scan(col: pa.Array) -> pa.Array:
        out: list[list[dict]] = [[] for _ in range(len(col))]
        for start, texts in text_slices(col, SHARD_CHARS):
            words = [words_of(t) for t in texts]
            for f in files:
                q = _load(f, window)
                for d, at, item, begin, n in longest(words, q):
                    out[start + d].append({"item_id": q.ids[item], "doc_word": at, "item_word": begin, "n_words": n})
        return pa.array(out, pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())])))

    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(scan(F.col(text))).alias("m")).select("doc_id", "m.*")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without the contaminated ones, all columns kept."""
    scan = hits_of(benchmark_files(benchmark), window)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(F.struct(*cols).alias("row"), scan(F.col(text)).alias("h")).where("not h.contaminated").select("row.*")
