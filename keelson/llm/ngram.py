"""Language-model scoring with Elias-Fano n-gram tries in memory-mapped levels.

The model is a bigram model. Relative frequencies of pairs are smoothed with
add-one frequencies of words (Jelinek-Mercer); contexts whose counts have as
many bits share a weight, learned from all of them. Its trie lies in files in
the shared folder:

* words, dealt by hash: word hashes in Elias-Fano form, with counts beside
  them. The place of a word is its number;
* pairs, dealt by hash of both numbers: contexts (Elias-Fano), monotone
  pointers (Elias-Fano) into the level below, and successors, made monotone by
  the place of their context, so that a search is relative to it; quantised
  logarithms of relative frequencies lie beside them.

Texts are read once, into batches of word numbers in the shared folder. A batch
asks the owners of its words and then those of its pairs: its questions and
their answers are shuffled by shard and back by batch, so each shard is mapped
by the one task that owns it, however many shards there are. Questions carry
the counts of learned texts, so an owner can build its level from them first.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.common import fold_of, shared_dir, written
from keelson.llm.files import ROW, as_bytes, as_table, by_batch, by_shard, groups, load, load_compressed, pack, remove_folder, rows_of, save, shard_of, squeeze, stretches, unpack, widen

#: No word has a space, so this is none.
END = b" </s>"
#: Share of a context's different successors that the weight of words alone counts; steps of a power of ten in stored logarithms, and what stands for none.
DISCOUNT, STEP, NONE = 0.8, 1024, 65535
#: Bytes of text for a shard of words and of pairs, tokens of a batch, and pairs looked up at once.
WORD_BYTES, PAIR_BYTES, HELD, ASKED = 32_000_000, 8_000_000, 1_000_000, 200_000


# --- Elias-Fano ---------------------------------------------------------------------------------

_BIT = np.full((256, 8), 8, np.int64)  # place of the k-th set bit of a byte
for _b in range(256):
    for _k, _i in enumerate([i for i in range(8) if _b >> i & 1]):
        _BIT[_b, _k] = _i


class EliasFano:
    """A monotone sequence: low bits in whole bytes, high bits in unary with ranks sampled by 64 bits.

    Its arrays may be mapped from a file, the ranks too if they are given.
    """

    def __init__(self, n: int, low_bytes: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray | None = None, zeros: np.ndarray | None = None):
        self.n, self.low_bytes, self.low, self.high = n, low_bytes, low, high
        self.ones, self.zeros = EliasFano.ranks(high) if ones is None else (ones, zeros)

    @staticmethod
    def ranks(high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ones = np.bitwise_count(high.view(np.uint64)).astype(np.int64)
        return np.cumsum(ones), np.cumsum(64 - ones)

    @staticmethod
    def stored(values: np.ndarray, universe: int) -> list[np.ndarray]:
        """As ``encode``, with the ranks."""
        parts = EliasFano.encode(values, universe)
        return [*parts, *EliasFano.ranks(parts[2])]

    @staticmethod
    def mapped(arrays: list[np.ndarray]) -> EliasFano:
        """The sequence of arrays that ``stored`` gave."""
        (n, low_bytes), *rest = arrays
        return EliasFano(int(n), int(low_bytes), *rest)

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> list[np.ndarray]:
        """Arrays [n, low_bytes], low, high of sorted ``values`` below ``universe``."""
        n = len(values)
        # the fewest bits in all: whole low bytes, and high bits with two ranks of 64 bits for each 64
        low_bytes = min(range(8), key=lambda b: 8 * b * n + 3 * (n + (universe - 1 >> 8 * b)))
        v = values.astype(np.uint64)
        low = v.view(np.uint8).reshape(-1, 8)[:, :low_bytes].ravel().copy() if n else np.zeros(0, np.uint8)
        top = (v >> np.uint64(8 * low_bytes)).astype(np.int64)
        bits = np.zeros((n + (int(universe - 1) >> 8 * low_bytes) + 1 + 64) // 64 * 64, np.uint8)
        bits[top + np.arange(n)] = 1
        return [np.array([n, low_bytes], np.int64), low, np.packbits(bits, bitorder="little")]

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th (from 0) set or unset bit."""
        cum = self.ones if ones else self.zeros
        word = np.searchsorted(cum, k, side="right")
        left = k - np.where(word > 0, cum[word - 1], 0)
        bytes_ = self.high.reshape(-1, 8)[np.minimum(word, len(cum) - 1)]
        bytes_ = bytes_ if ones else ~bytes_
        upto = np.cumsum(np.bitwise_count(bytes_), axis=1, dtype=np.uint8)
        i = np.minimum((upto <= left[:, None]).sum(axis=1), 7)
        rows = np.arange(len(k))
        left = left - np.where(i > 0, upto[rows, i - 1], 0)
        return word * 64 + i * 8 + _BIT[bytes_[rows, i], np.clip(left, 0, 7)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for b in range(self.low_bytes):
            out |= self.low[i * self.low_bytes + b].astype(np.uint64) << np.uint64(8 * b)
        return out

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(8 * self.low_bytes)) | self._low(i)

    def find(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Index of each value, or -1; only places from ``begin`` to ``end`` count, if given."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        x = x.astype(np.uint64, copy=False)
        top = (x >> np.uint64(8 * self.low_bytes)).astype(np.int64)
        inside = top < self.zeros[-1]  # beyond are values larger than any here
        top = np.where(inside, top, 0)
        lo = np.where(top > 0, self._select(np.maximum(top - 1, 0), False) - top + 1, 0)
        hi = np.where(inside, self._select(top, False) - top, lo)
        if begin is not None:
            lo, hi = np.maximum(lo, begin), np.minimum(hi, end)
        want = x & np.uint64((1 << 8 * self.low_bytes) - 1)
        last = hi
        while (open_ := lo < hi).any():  # the successor of x among the places that share its high bits
            mid = (lo + hi) >> 1
            below = self._low(np.minimum(mid, self.n - 1)) < want
            lo, hi = np.where(open_ & below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
        ok = lo < last
        ok[ok] = self._low(lo[ok]) == want[ok]
        return np.where(ok, lo, -1)


# --- batches of texts ---------------------------------------------------------------------------


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hash(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(w, 7) for w in words], np.uint64)


_END = word_hash([END])[0]


def _bits(n: np.ndarray) -> np.ndarray:
    """Bits of counts: contexts with as many share a weight."""
    return np.frexp(n.astype(np.float64))[1]


class Batch:
    """Texts as numbers of their distinct words; each is its words and its end."""

    def __init__(self, name: str) -> None:
        self.name = name
        self.number: defaultdict[bytes, int] = defaultdict(count(1).__next__, {END: 0})
        self.parts: list[np.ndarray] = []
        self.learn: list[bool] = []
        self.docs: list[pa.Table] = []
        self.tokens = 0

    def add(self, text: str | None, learn: bool) -> None:
        words = tokens_of(text)
        ids = np.zeros(len(words) + 1, np.int32)
        ids[:-1] = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
        self.parts.append(ids)
        self.learn.append(learn)
        self.tokens += len(ids)

    def close(self, folder: str, shards: int) -> pa.RecordBatch:
        """Writes the batch, its words numbered by shard and hash; gives the questions to each shard, with counts of learned texts."""
        sizes = np.array([len(p) for p in self.parts], np.int64)
        h = word_hash(list(self.number))
        shard = shard_of(h, shards)
        order = np.lexsort((h, shard))
        place = np.empty(len(h), np.int64)
        place[order] = np.arange(len(h))
        stream = place[np.concatenate(self.parts)]
        learn = np.array(self.learn, bool)
        counts = np.bincount(stream[np.repeat(learn, sizes)], minlength=len(h))
        docs = pa.concat_tables(self.docs).combine_chunks()
        save(f"{folder}/batch-{self.name}", [squeeze(sizes), squeeze(stream), learn, as_bytes(docs)], compressed=True)
        h, shard = h[order], shard[order]
        return rows_of([(self.name, s, pack([h[at], squeeze(counts[at])])) for s, at in stretches(shard)])


def read_texts(batches: Iterator[pa.RecordBatch], folder: str, shards: int) -> Iterator[pa.RecordBatch]:
    """Questions about the words of rows (doc_id, held_out, learn, text)."""
    part, names = TaskContext.get().partitionId(), count()
    held = Batch(f"{part}-{next(names)}")
    for rows in batches:
        docs, first = pa.Table.from_batches([rows.select(["doc_id", "held_out"])]), 0
        for i, (text, learn) in enumerate(zip(rows.column("text"), rows.column("learn").to_pylist())):
            held.add(text.as_py(), learn)
            if held.tokens >= HELD:
                held.docs.append(docs.slice(first, i + 1 - first))
                yield held.close(folder, shards)
                held, first = Batch(f"{part}-{next(names)}"), i + 1
        held.docs.append(docs.slice(first))
    if held.tokens:
        yield held.close(folder, shards)


# --- owners of shards ---------------------------------------------------------------------------


def _merge(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct keys in order, their summed counts, and where each was first."""
    order = np.lexsort(keys[::-1])
    keys, counts = [k[order] for k in keys], counts[order]
    if not len(counts):
        return keys, counts, order
    at = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))))
    return [k[at] for k in keys], np.add.reduceat(counts, at), order[at]


def own_words(batches: Iterator[pa.RecordBatch], folder: str, build: bool) -> Iterator[pa.RecordBatch]:
    """Answers each batch with places and counts of its words; builds the level first, if asked to.

    A row without a batch has a shard's words, tokens, and tokens of contexts by bits of their count.
    """
    for shard, rows in groups(batches, "shard"):
        blocks = [unpack(block) for _, block in rows]
        if build:
            h, n = np.concatenate([b[0] for b in blocks]), np.concatenate([widen(b[1]) for b in blocks])
            (h,), n, _ = _merge([h[n > 0]], n[n > 0])
            save(f"{folder}/words-{shard}", [*EliasFano.stored(h, 1 << 64), n])
            before = n[h != _END]
            yield rows_of([(None, shard, pack([np.array([len(n), n.sum()], np.int64), np.bincount(_bits(before), weights=before, minlength=64)]))])
        level = load(f"{folder}/words-{shard}")
        ef, n = (EliasFano.mapped(level[:5]), level[5]) if level else (None, None)
        for (batch, _), (h, _) in zip(rows, blocks):
            at = ef.find(h) if ef else np.full(len(h), -1, np.int64)
            known = at >= 0
            at = at[known]
            yield rows_of([(batch, shard, pack([np.array([len(h)], np.int64), np.packbits(known), squeeze(np.diff(at, prepend=0)), squeeze(n[at] if ef else at)]))])


class Words:
    """Numbers and counts of a batch's words, those of its texts' begin at the end; and its tokens."""

    def __init__(self, folder: str, batch: str, number: np.ndarray, counts: np.ndarray):
        sizes, stream, self.learn, docs = load_compressed(f"{folder}/batch-{batch}")
        self.number, self.counts, self.docs = number, counts, docs
        self.sizes, self.word = widen(sizes), widen(stream)
        self.before = np.roll(self.word, 1)
        self.before[np.cumsum(self.sizes) - self.sizes] = len(number) - 1
        self.of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.keys = self.before * len(number) + self.word

    def dealt(self, keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of those sorted distinct keys of which both words are known, by shard, and their shards."""
        u, v = self.number[keys // len(self.number)], self.number[keys % len(self.number)]
        known = np.flatnonzero((u >= 0) & (v >= 0))
        shard = shard_of(u[known], shards, v[known]).astype(np.uint32)
        order = np.argsort(shard, kind="stable")
        return known[order], shard[order]


def ask_pairs(batches: Iterator[pa.RecordBatch], folder: str, model: Model, build: bool, answer: bool) -> Iterator[pa.RecordBatch]:
    """Questions about the pairs of each batch, from the answers about its words: contexts, their counts and successors, and counts of learned texts.

    A row without a block makes sure that a batch without known pairs is not lost.
    """
    (first,) = load(f"{model.folder}/offsets")
    for batch, rows in groups(batches, "batch"):
        number, counts = [], []
        for shard, block in rows:
            (n,), bits, places, c = unpack(block)
            known = np.unpackbits(bits, count=n).astype(bool)
            own, seen = np.full(n, -1, np.int64), np.zeros(n, np.int64)
            own[known], seen[known] = first[shard] + np.cumsum(widen(places)), widen(c)
            number.append(own)
            counts.append(seen)
        number, counts = np.append(np.concatenate(number), model.v), np.append(np.concatenate(counts), model.docs)
        if answer:
            save(f"{folder}/known-{batch}", [squeeze(number + 1), squeeze(counts)], compressed=True)
            yield rows_of([(batch, zlib.crc32(batch.encode()) % model.pair_shards, None)])
        w = Words(folder, batch, number, counts)
        keys = np.sort(w.keys * 2 + np.repeat(w.learn, w.sizes))
        at = np.flatnonzero(np.concatenate(([True], keys[1:] >> 1 != keys[:-1] >> 1)))
        learned, keys = np.add.reduceat(keys & 1, at), keys[at] >> 1
        if not answer:
            keys, learned = keys[learned > 0], learned[learned > 0]
        mine, shard = w.dealt(keys, model.pair_shards)
        u, v, learned = keys[mine] // len(number), number[keys[mine] % len(number)], learned[mine]
        out = []
        for s, at in stretches(shard):
            x = u[at]
            new = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            arrays = [squeeze(np.diff(number[x[new]], prepend=0)), squeeze(np.diff(new, append=len(x))), squeeze(v[at])]
            out.append((batch, s, pack(arrays + ([squeeze(counts[x[new]]), squeeze(learned[at])] if build else []))))
        yield rows_of(out)


class Pairs:
    """The pair level of a shard, mapped."""

    def __init__(self, arrays: list[np.ndarray]):
        self.bits = np.uint64(arrays[0][0])
        self.contexts, self.pointers, self.successors = (EliasFano.mapped(arrays[i : i + 5]) for i in (1, 6, 11))
        self.logs = arrays[16]

    @staticmethod
    def stored(u: np.ndarray, v: np.ndarray, n: np.ndarray, total: np.ndarray) -> list[np.ndarray]:
        """Arrays of sorted distinct pairs with their counts and those of their contexts."""
        first = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1]))) if len(u) else np.zeros(0, np.int64)
        bits = max(1, int(v.max(initial=0)).bit_length())
        of = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff(first, append=len(u)))
        logs = np.minimum(np.round(-STEP * np.log10(n / total)), NONE - 1).astype(np.uint16)
        successors = (of << np.uint64(bits)) | v.astype(np.uint64)
        pointers = np.append(first, len(u))
        return [
            np.array([bits], np.int64),
            *EliasFano.stored(u[first], int(u.max(initial=0)) + 1),
            *EliasFano.stored(pointers, len(u) + 1),
            *EliasFano.stored(successors, max(1, len(first)) << bits),
            logs,
        ]

    def find(self, context: np.ndarray, each: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Stored logarithms of the successors of each context, ``each`` of them, or NONE."""
        if not self.contexts.n:
            return np.full(len(successor), NONE, np.uint16)
        at = self.contexts.find(context)
        found = np.maximum(at, 0)
        begin, end = (np.repeat(self.pointers.access(found + k).astype(np.int64), each) for k in (0, 1))
        ask = np.flatnonzero(np.repeat(at >= 0, each) & (successor >> self.bits.astype(np.int64) == 0))
        own = np.repeat(found.astype(np.uint64) << self.bits, each)
        got = self.successors.find(own[ask] | successor[ask].astype(np.uint64), begin[ask], end[ask])
        out = np.full(len(successor), NONE, np.uint16)
        out[ask] = np.where(got >= 0, self.logs[got], NONE)
        return out


def own_pairs(batches: Iterator[pa.RecordBatch], folder: str, build: bool, answer: bool) -> Iterator[pa.RecordBatch]:
    """Answers each batch with logarithms of its pairs; builds the level first, if asked to.

    A row without a batch has, by bits of a context's count, a shard's different successors.
    """
    for shard, rows in groups(batches, "shard"):
        yield rows_of([r for r in ((batch, shard, block) for batch, block in rows) if r[2] is None])
        rows = [(batch, [widen(a) for a in unpack(block)]) for batch, block in rows if block]
        if not rows:
            continue
        context = [np.cumsum(b[0]) for _, b in rows]
        if build:
            u, total = (np.concatenate([np.repeat(x, b[1]) for x, (_, b) in zip(of, rows)]) for of in (context, [b[3] for _, b in rows]))
            v, n = (np.concatenate([b[i] for _, b in rows]) for i in (2, 4))
            learned = n > 0
            u, v, n, total = u[learned], v[learned], n[learned], total[learned]
            (u, v), n, at = _merge([u, v], n)
            save(f"{folder}/pairs-{shard}", Pairs.stored(u, v, n, total[at]))
            yield rows_of([(None, shard, pack([np.bincount(_bits(total[at]), minlength=64)]))])
        if answer:
            level = load(f"{folder}/pairs-{shard}")
            trie = Pairs(level) if level else None
            for x, (batch, b) in zip(context, rows):
                parts, ends = [], np.cumsum(b[1])
                for a, z in ((a, a + ASKED) for a in range(0, len(x), ASKED)):
                    v = b[2][ends[a] - b[1][a] : ends[min(z, len(x)) - 1]]
                    parts.append(trie.find(x[a:z], b[1][a:z], v) if trie else np.full(len(v), NONE, np.uint16))
                yield rows_of([(batch, shard, pack([squeeze(np.concatenate(parts))]))])


# --- scores -------------------------------------------------------------------------------------

_SCORES = ["n_tokens", "n_known", "base_score", "score"]


def score_batches(batches: Iterator[pa.RecordBatch], folder: str, model: Model) -> Iterator[pa.RecordBatch]:
    """Scores of the texts of each batch from the answers about its pairs."""
    for batch, rows in groups(batches, "batch"):
        number, counts = (widen(a) for a in load_compressed(f"{folder}/known-{batch}"))
        w = Words(folder, batch, number - 1, counts)
        order = np.argsort(w.keys)
        keys = w.keys[order]
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        of, keys = np.cumsum(new) - 1, keys[new]
        u, v = keys // len(number), keys % len(number)
        base = np.log10((counts + 1) / (model.n + model.v + 1))
        q = np.full(len(keys), NONE, np.int64)
        got = [widen(unpack(block)[0]) for _, block in rows if block]
        mine, _ = w.dealt(keys, model.pair_shards)
        q[mine] = np.concatenate(got) if got else NONE
        weight = np.where(counts[u] > 0, model.weights[np.minimum(_bits(counts[u]), 63)], 1.0)
        pair = np.where(q == NONE, 0.0, 10.0 ** (-q / STEP))
        log = np.log10((1 - weight) * pair + weight * 10.0 ** base[v])
        n = len(w.sizes)
        known = np.bincount(w.of, weights=counts[w.word] > 0, minlength=n).astype(np.int64)
        scores = [w.sizes, known, np.bincount(w.of, weights=base[w.word], minlength=n), np.bincount(w.of[order], weights=log[of], minlength=n)]
        docs = as_table(w.docs)
        for rows_ in docs.to_batches():
            yield pa.RecordBatch.from_arrays([*rows_.columns, *[pa.array(x) for x in scores]], names=[*docs.schema.names, *_SCORES])


class Model:
    """What tasks need to ask for scores: where the levels lie, how many shards they have, totals and weights."""

    def __init__(self, folder: str, size: int, docs: int):
        self.folder, self.docs, self.n, self.v = folder, docs, 0, 0
        self.word_shards, self.pair_shards = max(1, -(-size // WORD_BYTES)), max(1, -(-size // PAIR_BYTES))
        #: by bits of a context's count, the weight of words alone
        self.weights = np.ones(64)

    def numbered(self, rows: list[tuple[int, bytes]]) -> np.ndarray:
        """Takes the totals of the word shards; where each one's numbers begin is written. Gives tokens by bits."""
        words, tokens = np.zeros(self.word_shards + 1, np.int64), np.zeros(64)
        for shard, block in rows:
            (words[shard + 1], n), by_bits = unpack(block)
            self.n += int(n)
            tokens += by_bits
        save(f"{self.folder}/offsets", [np.cumsum(words)])
        self.v = int(words.sum())
        return tokens


def _sizes(texts: DataFrame) -> tuple[int, int, int]:
    """Bytes of all texts, bytes and number of those to learn from."""
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return tuple(texts.agg(total(bytes_), total(F.when(F.col("learn"), bytes_)), total(F.col("learn").cast("bigint"))).first())


def _flow(rows: DataFrame, size: int, model: Model, build: bool, answer: bool) -> DataFrame | None:
    """Builds the model of rows (doc_id, held_out, learn, text) with learn, and scores all rows, or one of these."""
    folder = shared_dir(rows.sparkSession, "batches")
    asked = by_shard(rows.mapInArrow(lambda it: read_texts(it, folder, model.word_shards), ROW), model.word_shards)
    told = asked.mapInArrow(lambda it: own_words(it, model.folder, build), ROW)
    if build:  # totals come first
        told = written(told, "told", "zstd")
        tokens = model.numbered([(r.shard, bytes(r.block)) for r in told.where("batch is null").toLocalIterator()])
    pairs = by_shard(by_batch(told.where("batch is not null"), size).mapInArrow(lambda it: ask_pairs(it, folder, model, build, answer), ROW), model.pair_shards)
    told = pairs.mapInArrow(lambda it: own_pairs(it, model.folder, build, answer), ROW)
    if build:
        told = written(told, "told", "zstd")
        different = np.zeros(64)
        for r in told.where("batch is null").toLocalIterator():
            different += unpack(bytes(r.block))[0]
        tokens[_bits(np.array([model.docs]))] += model.docs  # those of the begin
        model.weights = np.minimum(np.where(tokens > 0, DISCOUNT * different / np.maximum(tokens, 1), 1.0), 0.999)
    if not answer:
        remove_folder(folder)
        return None
    kinds = zip(_SCORES, (T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("held_out", T.BooleanType()), *[T.StructField(c, t) for c, t in kinds]])
    return by_batch(told.where("batch is not null"), size).mapInArrow(lambda it: score_batches(it, folder, model), schema)


def train(texts: DataFrame, text: str = "text") -> Model:
    """The model of all rows of ``texts``; its size and its shards grow with them.

    All words and all pairs are kept, each under its own number. No word or
    context has its counts in one row or one task alone: a batch adds up its
    own, and pairs of a frequent word lie in all shards. The driver gets two
    short rows for each shard. Rows must come in the same order if they are
    read again, as those of tables do.
    """
    rows = texts.select(F.lit(0).alias("doc_id"), F.lit(False).alias("held_out"), F.lit(True).alias("learn"), F.col(text).alias("text"))
    size, learned, n_docs = _sizes(rows)
    model = Model(shared_dir(texts.sparkSession, "trie"), learned, n_docs)
    _flow(rows, size, model, True, False)
    return model


def _scored(docs: DataFrame, learn: Column, doc_id: str, text: str, folds: int, held: int) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), (fold_of(doc_id, folds) == held).alias("held_out"), learn.alias("learn"), F.col(text).alias("text"))


def _named(found: DataFrame, model: Model) -> DataFrame:
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("bigint").alias("train_tokens"), "base_score", "score")


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Null and empty texts are one token, the end. A null id is in fold 0.
    A model of no rows gives every token the same chance. Repeated rows stay
    repeated; other columns are not read.
    """
    rows = _scored(docs, F.lit(False), doc_id, text, folds, held)
    return _named(_flow(rows, _sizes(rows)[0], model, False, True), model)


def cross_scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """As ``score`` by the model of the rows outside fold ``held``: what ``train`` and ``score`` give, reading the texts once."""
    rows = _scored(docs, fold_of(doc_id, folds) != held, doc_id, text, folds, held)
    size, learned, n_docs = _sizes(rows)
    model = Model(shared_dir(docs.sparkSession, "trie"), learned, n_docs)
    return _named(_flow(rows, size, model, True, True), model)
