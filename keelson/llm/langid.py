"""Language ID, words first: per-language log frequencies, with shorter and shorter character n-grams for unseen words."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.llm.common import fold_of, least_hashed, text_slices

#: Labelled documents of each language that the model is fitted on, those with the least hashes.
SAMPLE = 3_000
#: Characters of the longest n-grams; different words that a task counts before it hands them on.
LONGEST, HELD = 5, 300_000
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def words_of(text: str) -> list[str]:
    """Runs of letters of a text, in lower case."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    # numerals such as \u00bd are no letters
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def gram_hashes(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each n, hashes of all n-grams of words between < and >, and the word of each."""
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    c = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), sizes)
    h = np.zeros(len(c), np.uint64)
    for n in range(1, LONGEST + 1):
        h = (h[: len(c) - n + 1] ^ c[n - 1 :]) * _MIX[0]
        h ^= h >> np.uint64(32)
        inside = of[: len(h)] == of[n - 1 :]
        yield n, (h[inside] + np.uint64(n)) * _MIX[1], of[: len(h)][inside]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, n, gram, c) of rows (lang, text); n is 0 for words, gram a hash. Words are added up first, HELD different ones at a time."""

    def counted(found: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, words in found.items():
            c = np.fromiter(words.values(), np.int64, len(words))
            for n, h, of in [(0, word_hashes(list(words)), np.arange(len(words))), *gram_hashes(list(words))]:
                keys, place = np.unique(h, return_inverse=True)
                sums = np.bincount(place, weights=c[of], minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), n, np.int32)), pa.array(keys.view(np.int64)), pa.array(sums)], names=["lang", "n", "gram", "c"])

    found: dict[str, Counter] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for start, texts in text_slices(batch.column("text")):
            for k, t in enumerate(texts):
                found.setdefault(langs[start + k], Counter()).update(words_of(t))
            if sum(map(len, found.values())) >= HELD:
                yield from counted(found)
                found = {}
    yield from counted(found)


@dataclass
class Model:
    langs: list[str]
    #: for words, and for n-grams of each length: sorted hashes, and their log frequencies by language
    keys: list[np.ndarray]
    logs: list[np.ndarray]

    def _found(self, n: int, h: np.ndarray) -> np.ndarray:
        """Places of hashes, or -1."""
        if not len(self.keys[n]):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys[n], h), len(self.keys[n]) - 1)
        return np.where(self.keys[n][at] == h, at, -1)

    def rows(self, words: list[str]) -> np.ndarray:
        """Log frequencies by language of each word: its own, or the mean of those of its longest known n-grams."""
        out = np.zeros((len(words), len(self.langs)))
        at = self._found(0, word_hashes(words))
        out[at >= 0] = self.logs[0][at[at >= 0]]
        unseen = np.flatnonzero(at < 0)
        asked = list(gram_hashes([words[i] for i in unseen.tolist()])) if len(unseen) else []
        open_ = np.ones(len(unseen), bool)
        for n, h, of in reversed(asked):
            h, of = h[open_[of]], of[open_[of]]
            at = self._found(n, h)
            of, at = of[at >= 0], at[at >= 0]
            hits = np.bincount(of, minlength=len(unseen))
            done = np.flatnonzero(hits)
            for k in range(len(self.langs)):
                out[unseen[done], k] = np.bincount(of, weights=self.logs[n][at, k], minlength=len(unseen))[done] / hits[done]
            open_[done] = False
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        out = [(UNDETERMINED, 0.0)] * len(texts)
        number: defaultdict[str, int] = defaultdict(count().__next__)
        ids = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in map(words_of, texts)]
        sizes = np.array([len(x) for x in ids], np.int64)
        if not self.langs or not sizes.sum():
            return out
        rows, ids = self.rows(list(number)), np.concatenate(ids)
        full = np.flatnonzero(sizes)
        z = np.add.reduceat(rows[ids], (np.cumsum(sizes) - sizes)[full], axis=0)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        for j, i in enumerate(full.tolist()):
            out[i] = (self.langs[best[j]], float(p[j, best[j]]))
        return out


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, sample: int = SAMPLE) -> Model:
    """The model of rows with a language whose fold is not 0, at most ``sample`` of each language.

    Rows alike in id and text count as one of the sample. The counting is
    spread over the cluster; the driver gets the counts of all words and
    n-grams of the sample, so ``sample`` bounds the model's size too.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("h"), fold_of(doc_id, folds).alias("fold")).where("lang is not null and text is not null and fold <> 0")
    # the hash of the sample's last row, so that texts needn't be sorted
    ranked = least_hashed(rows.select("lang", "h"), "lang", sample).distinct().withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("r") <= sample)
    last = ranked.groupBy("lang").agg(F.max("h").alias("last"))
    some = rows.join(F.broadcast(last), "lang")  # a row a language, as the model has a column a language.where("h <= last").select("lang", "text")
    counted = some.mapInArrow(_counts, "lang string, n int, gram bigint, c bigint").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    return model_of(counted.toArrow())


def model_of(counted: pa.Table) -> Model:
    """The model of rows (lang, n, gram, c)."""
    of, n, gram, c = (counted[k].combine_chunks() for k in ("lang", "n", "gram", "c"))
    langs = sorted(of.unique().to_pylist())
    column = np.array([langs.index(x) for x in of.unique().to_pylist()], np.int64)
    lang = column[np.asarray(of.dictionary_encode().indices)] if len(of) else np.zeros(0, np.int64)
    n, gram, c = np.asarray(n), np.asarray(gram).view(np.uint64), np.asarray(c)
    keys, logs = [], []
    for k in range(LONGEST + 1):
        mine = n == k
        known, place = np.unique(gram[mine], return_inverse=True)
        counts = np.zeros((len(known), len(langs)))
        counts[place, lang[mine]] = c[mine]
        keys.append(known)
        logs.append(np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(known) + 1)).astype(np.float32))
    return Model(langs, keys, logs)


def predictor(docs: DataFrame, model: Model):
    """Arrow UDF from a text column to struct<lang_pred, score>."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    chars = max(50_000, 8_000_000 // max(4, len(model.langs)))

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def scan(text: pa.Array) -> pa.Array:
        out: list[dict] = []
        for _, texts in text_slices(text, chars):
            out += [{"lang_pred": a, "score": b} for a, b in held.value.predict(texts)]
        return pa.array(out, pa.struct([("lang_pred", pa.string()), ("score", pa.float64())]))

    return scan


def identify(docs: DataFrame, model: Model | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text, in place, without a shuffle.

    Null and empty texts, and texts without a letter, are ``und`` with score 0;
    so is everything if no row could be learned from. Equal scores go to the
    first language by code point. A score is the chance of the predicted
    language, all its words taken as evidence. Rows without a language are not
    learned from.
    A null id is in fold 0. Repeated rows stay repeated; no other column is read.
    """
    scan = predictor(docs, model or fit(docs, doc_id, text, lang, folds))
    return docs.select(F.col(doc_id).alias("doc_id"), (fold_of(doc_id, folds) == 0).alias("held_out"), scan(F.col(text)).alias("p")).select("doc_id", "held_out", "p.*")


def keep_identified(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without those that are ``und`` or score below ``least``, all columns kept."""
    scan = predictor(docs, model)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(F.struct(*cols).alias("row"), scan(F.col(text)).alias("p")).where((F.col("p.lang_pred") != UNDETERMINED) & (F.col("p.score") >= least)).select("row.*")
