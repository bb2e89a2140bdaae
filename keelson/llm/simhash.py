"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint has eight bytes. If two differ in at most four bits, they differ
in at most four bytes, so they share at least four positional bytes. The index
has a posting for each choice of four positions and the bytes there (70 a
fingerprint); two fingerprints in one posting share at least these four. The
tally of all positional bytes that a pair shares keeps the pair in one posting
only (that of its first four shared positions), and the differing bits verify it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.common import per_text, written
from keelson.llm.components import components

SEED = 42
SHINGLE = 4
#: Differing bits within which fingerprints link, and positional bytes that such a pair shares at least.
BITS, SHARED = 4, 4
POSITIONS = list(combinations(range(8), SHARED))
#: Fingerprints of a posting compared in one piece; longer postings are dealt out in pairs of blocks.
BLOCK = 4096


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the lower-cased four-word shingles of a whole text; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - SHINGLE + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[SHINGLE - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, 50_000):
        h = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 50_000], ends[at : at + 50_000])])
        ones += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@F.arrow_udf(T.LongType())
def fingerprint_of(text: pa.Array) -> pa.Array:
    return per_text(lambda texts: [_signed(fingerprint(t)) for t in texts], pa.int64())(text)


def _roots(near: np.ndarray) -> np.ndarray:
    """Index of each row's smallest reachable row in a symmetric boolean matrix."""
    label = np.arange(len(near), dtype=np.int32)
    while True:
        least = label.copy()
        for at in range(0, len(near), 256):  # a few rows at a time: all of them would be a matrix of numbers
            mine = slice(at, at + 256)
            least[mine] = np.minimum(least[mine], np.where(near[mine], label[None, :], len(near)).min(axis=1, initial=len(near)))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _canonical(x: np.ndarray, s: np.ndarray | int) -> np.ndarray:
    """Whether posting ``s`` is that of the first four positional bytes shared by pairs with XOR ``x``."""
    return FIRST[_tally(x)] == s


def _tally(x: np.ndarray) -> np.ndarray:
    """Bit i is set where byte i (from the lowest) of a pair's XOR is zero: the positions it shares."""
    shared = np.zeros(x.shape, np.uint8)
    for i in range(8):
        shared |= (((x >> np.uint64(8 * i)) & np.uint64(255)) == 0).astype(np.uint8) << i
    return shared


def _first_table() -> np.ndarray:
    at = {p: k for k, p in enumerate(POSITIONS)}
    out = np.full(256, -1, np.int16)
    for m in range(256):
        on = [i for i in range(8) if m >> i & 1]
        if len(on) >= SHARED:
            out[m] = at[tuple(on[:SHARED])]
    return out


FIRST = _first_table()


def _linked(x: np.ndarray, s: np.ndarray | int) -> np.ndarray:
    close = np.bitwise_count(x) <= BITS
    close[close] = _canonical(x[close], s if np.isscalar(s) else np.broadcast_to(s, x.shape)[close])
    return close


def _run_links(fp: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one posting: far fewer rows than its pairs."""
    near = np.zeros((len(fp), len(fp)), bool)
    for at in range(0, len(fp), 512):
        near[at : at + 512] = _linked(fp[at : at + 512, None] ^ fp[None, :], s)
    np.fill_diagonal(near, False)
    root = _roots(near)
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return fp[moved], fp[root[moved]]


def _search(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[pa.RecordBatch]:
    """Links within the postings of rows (s, v, k, fp) sorted by posting.

    A posting of more than ``limit`` rows gives its rows again, numbered, to be
    dealt out in pairs of blocks: columns a, b for links, s, v, fp, rank for rows.
    """
    none = np.zeros(0, np.uint64)
    rest: list[np.ndarray] = [np.zeros(0, np.int16), np.zeros(0, np.int64), np.zeros(0, np.int64), none]
    passing: tuple | None = None  # posting whose rows stream through, and how many have

    def emit(a: np.ndarray, b: np.ndarray, s: np.ndarray, v: np.ndarray, fp: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
        n, m = len(a), len(s)
        gap = lambda k, t: pa.nulls(k, t)
        both = lambda x, t, first: pa.concat_arrays([pa.array(x, t), gap(m, t)] if first else [gap(n, t), pa.array(x, t)])
        return pa.RecordBatch.from_arrays(
            [both(a.view(np.int64), pa.int64(), True), both(b.view(np.int64), pa.int64(), True), both(s, pa.int16(), False), both(v, pa.int64(), False), both(fp.view(np.int64), pa.int64(), False), both(rank, pa.int64(), False)],
            names=["a", "b", "s", "v", "fp", "rank"],
        )

    def runs(s: np.ndarray, v: np.ndarray, k: np.ndarray, fp: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal passing, rest
        new = np.flatnonzero((s[1:] != s[:-1]) | (v[1:] != v[:-1]) | (k[1:] != k[:-1])) + 1
        starts = np.concatenate(([0], new)).astype(np.int64) if len(s) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate((starts, [len(s)])))
        if len(sizes) and not last and (limit is None or sizes[-1] <= limit) and passing is None:
            rest = [x[starts[-1] :] for x in (s, v, k, fp)]
            starts, sizes = starts[:-1], sizes[:-1]
        else:
            rest = [x[:0] for x in (s, v, k, fp)]
        small = np.flatnonzero((sizes > 1) & (sizes <= 64))
        got_a, got_b = [none], [none]
        if len(small):
            for d in range(1, int(sizes[small].max())):
                here = small[sizes[small] > d]
                first = np.repeat(starts[here], sizes[here] - d) + np.concatenate([np.arange(x) for x in sizes[here] - d])
                x = fp[first] ^ fp[first + d]
                on = _linked(x, s[first])
                got_a.append(fp[first + d][on])
                got_b.append(fp[first][on])
        hot: list[tuple] = []
        for i in np.flatnonzero(sizes > 64):
            a, z = starts[i], starts[i] + sizes[i]
            if limit is not None and sizes[i] > limit:
                hot.append((s[a:z], v[a:z], fp[a:z], np.arange(z - a)))
            else:
                x, y = _run_links(fp[a:z], int(s[a]))
                got_a.append(x)
                got_b.append(y)
        cat = [np.concatenate(c) for c in zip(*hot)] if hot else [np.zeros(0, np.int16), np.zeros(0, np.int64), none, np.zeros(0, np.int64)]
        yield emit(np.concatenate(got_a), np.concatenate(got_b), *cat)

    for batch in batches:
        s, v, k, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("s", "v", "k", "fp"))
        fp = fp.view(np.uint64)
        if passing is not None:  # a long posting goes on: its rows pass through without being held
            same = (s == passing[0]) & (v == passing[1])
            n = len(s) if same.all() else int(np.argmin(same))
            if n:
                yield emit(none, none, s[:n], v[:n], fp[:n], passing[2] + np.arange(n))
            passing = (*passing[:2], passing[2] + n) if n == len(s) else None
            s, v, k, fp = s[n:], v[n:], k[n:], fp[n:]
            if not len(s):
                continue
        s, v, k, fp = (np.concatenate((r, x)) for r, x in zip(rest, (s, v, k, fp)))
        tail = len(s) - int(np.argmin(((s == s[-1]) & (v == v[-1]) & (k == k[-1]))[::-1])) if not ((s == s[-1]) & (v == v[-1]) & (k == k[-1])).all() else 0
        yield from runs(s, v, k, fp, False)
        if limit is not None and len(s) - tail > limit:
            passing = (s[-1], v[-1], len(s) - tail)
    if len(rest[0]):
        yield from runs(*rest, True)


_FOUND = "a bigint, b bigint, s smallint, v bigint, fp bigint, rank bigint"


def fingerprint_links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b) fingerprint pairs whose links connect the same fingerprints as all pairs within BITS bits.

    ``distinct`` has one row for each fingerprint, in column fp. Within a
    posting the links come as a spanning forest, so thousands of near copies
    give as many rows as they are, not as many as their pairs. A posting of
    more than ``block`` fingerprints is never held by one task: its rows are
    numbered and dealt out to all pairs of its blocks.
    """
    spark = distinct.sparkSession
    masks = [_signed(sum(255 << 8 * i for i in p)) for p in POSITIONS]
    postings = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("s", "v"))
    postings = postings.select(F.col("s").cast("smallint").alias("s"), "v", F.lit(0).cast("bigint").alias("k"), "fp")
    found = postings.repartition("s", "v").sortWithinPartitions("s", "v").mapInArrow(lambda it: _search(it, block), _FOUND)
    found = written(found, "postings")
    links = found.where("a is not null").select("a", "b")
    long = found.where("fp is not null")
    if long.isEmpty():
        return links
    blocks = long.groupBy("s", "v").agg(F.ceil((F.max("rank") + 1) / block).alias("n"))
    me = F.floor(F.col("rank") / block)
    dealt = long.join(blocks, ["s", "v"]).select("s", "v", "fp", "n", me.alias("me"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("other"))
    dealt = dealt.select("s", "v", (F.least("me", "other") * F.col("n") + F.greatest("me", "other")).alias("k"), "fp")
    more = dealt.repartition("s", "v", "k").sortWithinPartitions("s", "v", "k").mapInArrow(lambda it: _search(it, None), _FOUND)
    return links.unionByName(written(more.select("a", "b"), "blocks").select("a", "b"))


def _classes(rows: DataFrame, block: int) -> DataFrame:
    """(fp, root, component_id) for each fingerprint of ``rows`` (doc_id, fp)."""
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    parts = components(fingerprint_links(distinct.select("fp"), block), "a", "b")
    rooted = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; fp is the signed fingerprint.

    Texts whose fingerprints differ in at most four bits link; component_id is
    the smallest doc_id that links reach, the document's own included. Copies
    are not expanded: fingerprints are compared once each and joined back.
    Null and empty texts have fingerprint 0, like any text without words.
    A null doc_id has no part in component_id, which is null only if all of its
    component's are. Repeated rows stay repeated. Other columns are not read.
    """
    rows = written(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_of(F.col(text)).alias("fp")), "fingerprints")
    return rows.join(_classes(rows, block), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest doc_id, all columns kept.

    Null ids come last; of rows that share the smallest doc_id of a group any
    one stays. The texts are written once, with fingerprint and row number, so
    that neither is computed again.
    """
    cols = [F.col(f"`{c}`") for c in docs.columns]
    held = written(docs.select(F.struct(*cols).alias("row"), F.col(doc_id).alias("doc_id"), fingerprint_of(F.col(text)).alias("fp"), F.monotonically_increasing_id().alias("rid")), "held")
    roots = _classes(held.select("doc_id", "fp"), block).select("fp", "root")
    stay = held.select("doc_id", "fp", "rid").join(roots, "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first"))
    return held.join(stay.select(F.col("first.rid").alias("rid")), "rid", "left_semi").select("row.*")
