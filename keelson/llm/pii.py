"""Personal data: checked patterns give seed entities, and the contexts they share find more.

Bootstrapping: every seed and every unproven candidate stands in lexical
patterns, the words around it. Candidates are spans shaped like an identifier
that the base patterns do not take, and any other word with a digit, of any
shape, which is proposed by the patterns of seeds that it stands in, as one of
their kind. Patterns and instances form a bipartite graph, scored in turn: a
pattern by the share of its instances that are trusted, an instance by its
patterns. Candidates that end with high confidence are added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.common import text_slices, written

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring, least trusted instances of a pattern, and least confidence of an instance to be added.
ROUNDS, SUPPORT, CONFIDENCE = 3, 5.0, 0.9

# Possessive forms of the base patterns: each finds what the plain one does, in time linear in the text.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Shapes of candidates: spaced or bracketed digits, and mail names with a spelt-out or broken sign (a name has 64 characters at most,
# a label 63, as mail has it); and words of any shape and length with a digit.
_DIGITS = re.compile(r"(?<![\w.])[(+]?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}+(?![\w])")
_SPELT = re.compile(r"(?<![\w.])[A-Za-z0-9._%+-]{1,64}+\x20?[\[({]\x20?at\x20?[\])}]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?)[A-Za-z0-9-]{1,63}+)*", re.I)
_ANY = re.compile(r"(?<!\S)[^\s0-9]*+[0-9]\S*+")
#: Kind of a candidate that patterns are to tell; characters around a span in which its patterns' words are looked for; instances longer than this go by a digest.
UNTOLD, AROUND, LONG = -1, 40, 64
_BEFORE = re.compile(r"([^\W\d_]+)[^\w]{0,3}$")
_AFTER = re.compile(r"[^\w]{0,3}([^\W\d_]+)")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and apart within a kind, by kind and start."""
    out: list[tuple[int, int, int]] = []
    at, end = text.find("@"), 0
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((0, a, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if m[1] and all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def _patterns(text: str, a: int, z: int) -> list[str]:
    """Lexical patterns around a span: the word before, the word after, and both."""
    left, right = _BEFORE.search(text[max(0, a - AROUND) : a]), _AFTER.match(text[z : z + AROUND])
    l, r = left[1].lower() if left else "", right[1].lower() if right else ""
    return ([f"{l} _"] if l else []) + ([f"_ {r}"] if r else []) + ([f"{l} _ {r}"] if l and r else [])


class _Taken:
    """Which spans are taken, for questions in the logarithm of their number."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.upto, most = [], [0], 0
        for a, z in sorted(spans):
            self.starts.append(a)
            most = max(most, z)
            self.upto.append(most)

    def free(self, a: int, z: int) -> bool:
        """Whether none of them has a character from ``a`` to ``z``: none that begins before ``z`` ends after ``a``."""
        return self.upto[bisect_left(self.starts, z)] <= a


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of spans shaped like an identifier that no base span touches, and of other words with a digit, whose kind is UNTOLD."""
    taken = _Taken([(a, z) for _, a, z in base])
    out = []
    for m in _SPELT.finditer(text) if re.search(r"[\[({]\x20?at\x20?[\])}]", text, re.I) else ():
        out.append((0, *m.span()))
    for m in _DIGITS.finditer(text):
        n = len(_digits(m[0]))
        out.append((1 if m[0].count(".") == 3 and n <= 12 else 2 if n >= 13 else 3, *m.span()))
    out = [c for c in out if taken.free(c[1], c[2])]
    taken = _Taken([(a, z) for _, a, z in base + out])
    for m in _ANY.finditer(text):
        a, z = m.span()
        while a < z and not text[a].isalnum():
            a += 1
        while a < z and not text[z - 1].isalnum():
            z -= 1
        if taken.free(a, z):
            out.append((UNTOLD, a, z))
    return out


def _instance(s: str) -> str:
    s = s.lower()
    return s if len(s) <= LONG else "#" + hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_FOUND = pa.struct([("base", pa.list_(_SPAN)), ("slots", pa.list_(pa.struct([("span", _SPAN), ("seed", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])))])
_FOUND_DDL = "struct<base: array<struct<kind: int, start: int, end: int>>, slots: array<struct<span: struct<kind: int, start: int, end: int>, seed: boolean, instance: string, patterns: array<string>>>>"


def find(text: str) -> dict:
    """Base spans of a text, and its slots: seeds and candidates with their patterns."""
    base = base_spans(text)
    named = lambda s: dict(zip(("kind", "start", "end"), s))
    slot = lambda s, seed: {"span": named(s), "seed": seed, "instance": _instance(text[s[1] : s[2]]), "patterns": _patterns(text, s[1], s[2])}
    return {"base": [named(s) for s in base], "slots": [slot(s, True) for s in base] + [slot(s, False) for s in candidates(text, base)]}


def _scan():
    @F.arrow_udf(_FOUND_DDL)
    def scan(text: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([find(t) for t in texts], _FOUND) for _, texts in text_slices(text)] or [pa.array([], _FOUND)])

    return scan


def trusted_instances(slots: DataFrame, rounds: int = ROUNDS, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(kind, instance, conf) of the candidates that the pattern-instance graph ends up trusting.

    ``slots`` has kind, seed, instance and pattern. Each round is two joins and
    two aggregations of the distinct edges, which are far fewer than documents;
    all sums have partial aggregates, so a frequent pattern is never gathered.
    """
    edges = written(slots.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    conf = edges.groupBy("kind", "instance").agg(F.max("seed").cast("double").alias("conf"), F.max("seed").alias("seed"))
    for _ in range(rounds):
        held = edges.select("kind", "pattern", "instance").join(conf, ["kind", "instance"])
        patterns = held.groupBy("kind", "pattern").agg(F.sum("conf").alias("support"), F.avg("conf").alias("share")).where(F.col("support") >= support)
        # an instance is as sure as its patterns together: the chance that not all of them err
        odds = edges.where("not seed").join(patterns, ["kind", "pattern"]).groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("share"), F.lit(1e-6)))))).alias("new"))
        conf = written(conf.join(odds, ["kind", "instance"], "left").select("kind", "instance", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("new", F.lit(0.0))).alias("conf"), "seed"), "confidence")
    return conf.where((~F.col("seed")) & (F.col("conf") >= confidence)).select("kind", "instance", "conf")


def _told(edges: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Edges whose kinds are all told: those of UNTOLD candidates get each kind of whose seeds their pattern has ``support`` or more.

    Other patterns cannot come to be trusted before a seed's instance is, so nothing else can be found through them.
    """
    seeded = edges.where("seed").groupBy("kind", "pattern").agg(F.count_distinct("instance").alias("n")).where(F.col("n") >= support).select("kind", "pattern")
    untold = edges.where(F.col("kind") == UNTOLD).select("instance", "pattern").distinct().join(seeded, "pattern").select("kind", F.lit(False).alias("seed"), "instance", "pattern")
    return edges.where(F.col("kind") != UNTOLD).unionByName(untold)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _with_spans(docs: DataFrame, text: str, keep_row: bool, doc_id: str = "doc_id") -> DataFrame:
    """Rows with base and all spans; the found spans are written once, so texts are searched once."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    row = F.struct(*cols) if keep_row else F.struct(F.col(doc_id).alias("doc_id"))
    held = written(docs.select(row.alias("row"), _scan()(F.col(text)).alias("f"), F.monotonically_increasing_id().alias("rid")).select("row", "f.*", "rid"), "found")
    slots = held.select("rid", F.explode("slots").alias("s")).select("rid", "s.span", "s.seed", "s.instance", "s.patterns", F.col("s.span.kind").alias("kind"))
    edges = slots.select("kind", "seed", "instance", F.explode("patterns").alias("pattern"))
    trusted = trusted_instances(_told(edges))
    # a word of no told kind is of the one it is surest to be, the first of equal ones
    surest = trusted.groupBy("instance").agg(F.max(F.struct("conf", (-F.col("kind")).alias("kind"))).alias("s")).select(F.lit(UNTOLD).alias("kind"), "instance", (-F.col("s.kind")).alias("as_kind"))
    named = trusted.select("kind", "instance", F.col("kind").alias("as_kind")).unionByName(surest)
    hits = slots.where("not seed").select("rid", "span", "kind", "instance").join(named, ["kind", "instance"])
    more = hits.groupBy("rid").agg(F.collect_list(F.struct(F.col("as_kind").alias("kind"), F.col("span.start").alias("start"), F.col("span.end").alias("end"))).alias("more"))
    none = F.array().cast("array<struct<kind: int, start: int, end: int>>")
    return held.drop("slots").join(more, "rid", "left").withColumn("spans", F.array_sort(F.concat("base", F.coalesce("more", none))))


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row of ``docs``.

    Counts and digest are of the base spans; spans lists base and added ones.
    Offsets are code points. Null texts are empty; texts without spans have
    counts 0 and an empty list. Repeated rows stay repeated, ids may be null,
    other columns are not read.
    """
    found = _with_spans(docs, text, False, doc_id)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    return found.select("row.doc_id", *[count(k) for k in range(4)], F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("bigint").alias("n_added"))


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, end = [], 0
    for kind, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{KINDS[kind].upper()}]"]
        end = max(end, z)
    return "".join([*out, text[end:]])


@F.arrow_udf(T.StringType())
def _redacted(text: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([t.as_py() if not t.is_valid else redact_text(t.as_py(), [(x["kind"], x["start"], x["end"]) for x in s.as_py() or []]) for t, s in zip(text, spans)], pa.string())


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced by its kind, every row and column kept; ``n_chars`` follows the text."""
    found = _with_spans(docs, text, True)
    fresh = F.when(F.size("spans") > 0, _redacted(F.col(f"row.`{text}`"), F.col("spans"))).otherwise(F.col(f"row.`{text}`"))
    out = found.select("row", fresh.alias("fresh"))
    value = {text: F.col("fresh")} | ({n_chars: F.length("fresh").cast(docs.schema[n_chars].dataType)} if n_chars in docs.columns else {})
    return out.select(*[value.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
