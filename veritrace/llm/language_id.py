"""Language identification by interpolated Kneser-Ney character models.

One model a language, each a set of sorted hash arrays by order: the 64-bit hash of an n-gram and its smoothed log
probability, the hash of a context and its back-off mass. A text goes to the language of the lowest cross-entropy a
character. A prediction is accepted if its cross-entropy stays under a limit calibrated for that language on training
rows that its counts did not see.

Texts are lower-cased character by character, everything but letters and marks becomes one space. The highest order
takes plain counts, lower orders count distinct left neighbours; unseen characters share a uniform floor.

Training takes a sample of at most `sample_docs` rows a language in expectation (by a hash of the id; rows over
`sample_chars` characters are not sampled), split in two: counts from four fifths, limits from one fifth.

Defined results: `und`, score 0 and not accepted where the text is null or has no letter; ties go to the first
language by name; no training rows: every text is `und`. lang, source and id are never read for a prediction.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, packed, remainder, unpacked

ORDER = 5
DISCOUNT = 0.75
ALPHABET = 4096  # the uniform floor spreads its mass over so many characters
SAMPLE_DOCS = 1500
SAMPLE_CHARS = 200_000
MARGIN = 1.6  # a limit is this times the quantile of the calibration rows: passages in a second language stay in
QUANTILE = 0.999
SLACK = 24.0  # bits that a text may spend beyond its limit: short texts are kept on thin evidence
BLOCK = 1 << 16  # characters scored at once: arrays that fit a core's cache
UNDETERMINED = "und"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 0x20

LEVEL = {"keys": np.uint64, "logp": np.float32, "prefix": np.uint64, "suffix": np.uint64, "contexts": np.uint64, "mass": np.float32}


def _letters() -> np.ndarray:
    """Code point -> lower-cased letter or mark, or a space."""
    table = np.full(sys.maxunicode + 1, _SPACE, np.uint32)
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        if unicodedata.category(c)[0] in "LM":
            low = c.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


_table: list[np.ndarray] = []


def _has_letter(points: np.ndarray) -> bool:
    """Whether a code point is a letter; marks alone are none."""
    return any(unicodedata.category(chr(p))[0] == "L" for p in np.unique(points).tolist() if p != _SPACE)


def characters(text: str | None) -> np.ndarray:
    """The code points that models see: one space on either side and between words; empty where no letter is."""
    if not _table:
        _table.append(_letters())
    raw = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    points = _table[0][raw]
    points = np.concatenate(([_SPACE], points, [_SPACE])).astype(np.uint32)
    space = points == _SPACE
    points = points[~(space & np.concatenate(([False], space[:-1])))]
    # a text of marks alone has few kinds of characters: only such a one is looked at twice
    return points if len(points) > 1 and (_has_letter(points[:64]) or _has_letter(points)) else points[:0]


def gram_hashes(points: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order the hash of the n characters that end at each place (shorter near the start: hash 0)."""
    own = (points.astype(np.uint64) + np.uint64(1)) * _MIX
    own ^= own >> np.uint64(29)
    out = [own]
    for n in range(2, order + 1):
        # the hash of n characters: that of the n - 1 before the last, mixed, plus the last
        before = out[-1][:-1]
        h = np.zeros_like(own)
        h[1:] = (before ^ (before >> np.uint64(31))) * _MIX + own[1:] * np.uint64(2 * n + 1)
        h[: n - 1] = 0
        out.append(h)
    return out


def _distinct_grams(texts: list[str], n: int) -> tuple[np.ndarray, ...]:
    """Of all n-grams after n characters the distinct hashes, those of their first and last n characters, and counts.
    Texts are merged a block at a time, so memory follows the distinct n-grams, not the texts."""
    held: list[tuple[np.ndarray, ...]] = []
    merged = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint64, np.float64))
    size = 0
    for k, text in enumerate(texts):
        points = characters(text)
        if len(points):
            hashes = gram_hashes(points, n + 1)
            zero = np.zeros(len(points), np.uint64)
            held.append((hashes[n][n:], hashes[n - 1][n - 1 : -1] if n else zero, hashes[n - 1][n:] if n else zero, np.ones(len(points) - n)))
            size += len(points)
        if size >= 16 * BLOCK or k == len(texts) - 1:
            keys, prefix, suffix, counts = (np.concatenate(x) for x in zip(merged, *held, strict=True))
            distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
            merged = distinct, prefix[first], suffix[first], np.bincount(which, counts, len(distinct))
            held, size = [], 0
    return merged


def kneser_ney(texts: list[str], order: int = ORDER, discount: float = DISCOUNT) -> list[tuple[np.ndarray, ...]]:
    """By order the arrays of LEVEL: sorted n-gram hashes, their log2 probabilities, the hashes of their first and last
    n - 1 characters, sorted context hashes and their log2 back-off masses."""
    levels = [_distinct_grams(texts, n) for n in range(order)]
    out, lower_keys, lower_p = [], np.zeros(0, np.uint64), np.zeros(0)
    for n in range(order):
        keys, pre, _, counts = levels[n]
        if n < order - 1:  # continuation counts: distinct characters to the left
            above = levels[n + 1][2]
            known, left = np.unique(above, return_counts=True)
            at = np.searchsorted(known, keys)
            at[at == len(known)] = 0
            hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            counts = np.where(hit, left[at] if len(known) else 1, 1).astype(np.float64)
        contexts, which = np.unique(pre, return_inverse=True)
        total = np.bincount(which, counts, len(contexts))
        kinds = np.bincount(which, minlength=len(contexts))
        mass = discount * kinds / np.maximum(total, 1)
        if n:
            at = np.searchsorted(lower_keys, levels[n][2])
            below = lower_p[np.minimum(at, len(lower_p) - 1)]
        else:
            below = np.full(len(keys), 1 / ALPHABET)
        p = np.maximum(counts - discount, 0) / np.maximum(total[which], 1) + mass[which] * below if len(keys) else np.zeros(0)
        out.append((keys, np.log2(p).astype(np.float32), pre, levels[n][2], contexts, np.log2(mass).astype(np.float32)))
        lower_keys, lower_p = keys, p
    return out


@dataclass
class Lookup:
    """Sorted hashes with a directory over their top bits, so that a search begins next to its end."""

    keys: np.ndarray
    starts: np.ndarray
    shift: np.uint64
    steps: int

    @classmethod
    def of(cls, keys: np.ndarray) -> Lookup:
        bits = max(1, min(20, int(np.ceil(np.log2(max(len(keys), 2)))) + 1))
        shift = np.uint64(64 - bits)
        starts = np.searchsorted(keys >> shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        return cls(keys, starts, shift, int(np.diff(starts).max(initial=0)))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of hashes, -1 where absent."""
        top = (hashes >> self.shift).astype(np.int64)
        at, end = self.starts[top].astype(np.int64), self.starts[top + 1]
        out = np.full(len(hashes), -1, np.int64)
        live = np.flatnonzero(at < end)
        at = at[live]
        for _ in range(self.steps):
            same = self.keys[at] == hashes[live]
            out[live[same]] = at[same]
            at += 1
            more = ~same & (at < end[live])
            live, at = live[more], at[more]
            if not len(live):
                break
        return out


class Identifier:
    """All languages' models over common sorted hash arrays: one search an order serves every language."""

    def __init__(self, models: dict[str, list[tuple]], limits: dict[str, float], order: int = ORDER):
        self.langs, self.order = sorted(models), order
        self.limits = np.array([limits.get(x, np.inf) for x in self.langs])
        self.floor = np.float32(np.log2(1 / ALPHABET))
        self.grams, self.logp, self.contexts, self.mass = [], [], [], []
        for n in range(order if models else 0):
            level = [dict(zip(LEVEL, models[x][n], strict=True)) for x in self.langs]
            keys, first = np.unique(np.concatenate([a["keys"] for a in level]), return_index=True)
            prefix, suffix = (np.concatenate([a[c] for a in level])[first] for c in ("prefix", "suffix"))
            contexts = np.unique(np.concatenate([a["contexts"] for a in level]))
            mass = np.zeros((len(contexts), len(self.langs)), np.float32)
            for i, a in enumerate(level):
                mass[np.searchsorted(contexts, a["contexts"]), i] = a["mass"]
            # where only other languages know an n-gram, its value is that of backing off
            logp = mass[np.searchsorted(contexts, prefix)]
            logp += self.logp[-1][self.grams[-1].find(suffix)] if n else self.floor
            for i, a in enumerate(level):
                logp[np.searchsorted(keys, a["keys"]), i] = a["logp"]
            self.grams.append(Lookup.of(keys))
            self.contexts.append(Lookup.of(contexts))
            self.logp.append(logp)
            self.mass.append(mass)

    def log2(self, points: np.ndarray) -> np.ndarray:
        """log2 probability of each character but the first, by language."""
        hashes = gram_hashes(points, self.order)
        value = np.zeros((len(points) - 1, len(self.langs)), np.float32)
        todo = np.arange(self.order - 2, len(value))  # places with the whole context before them
        short = np.arange(min(self.order - 2, len(value)))
        for n in range(self.order - 1, -1, -1):
            if n < self.order - 1:
                todo = np.concatenate((todo, short[short == n - 1]))
            at = self.grams[n].find(hashes[n][todo + 1])
            hit = at >= 0
            value[todo[hit]] += self.logp[n][at[hit]]
            todo = todo[~hit]
            if len(todo):
                c = self.contexts[n].find(hashes[n - 1][todo] if n else np.zeros(len(todo), np.uint64))
                value[todo[c >= 0]] += self.mass[n][c[c >= 0]]
        value[todo] += self.floor
        return value

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character by text and language, and the number of characters scored (0: no letter)."""
        bits, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        gap = np.zeros(self.order - 1, np.uint32)  # no model knows it, so that no text sees the one before it
        pending: list[tuple[int, int, np.ndarray]] = []
        waiting = 0

        def flush() -> None:
            joined = np.concatenate([p for _, _, parts in pending for p in (gap, parts)])
            value = np.concatenate((np.zeros((1, len(self.langs)), np.float32), self.log2(joined)))
            starts = np.cumsum([0] + [len(gap) + len(p) for _, _, p in pending])
            for (i, given, _), a, b in zip(pending, starts, starts[1:], strict=False):
                bits[i] -= value[a + len(gap) + given : b].sum(axis=0, dtype=np.float64)
            pending.clear()

        for i, text in enumerate(texts):
            points = characters(text)
            sizes[i] = max(0, len(points) - 1)
            for at in range(1, len(points), BLOCK):
                given = min(at, self.order - 1)  # what is scored already, or the first space
                pending.append((i, given, points[at - given : at + BLOCK]))
                waiting += len(pending[-1][2])
                if waiting >= BLOCK:
                    flush()
                    waiting = 0
        if pending:
            flush()
        return bits / np.maximum(sizes, 1)[:, None], sizes

    def predict(self, texts: list[str | None]) -> list[tuple]:
        """(lang_pred, score, cross_entropy, accepted) of each text."""
        if not self.langs:
            return [(UNDETERMINED, 0.0, None, False)] * len(texts)
        h, sizes = self.entropies(texts)
        best = h.argmin(axis=1)
        low = h[np.arange(len(h)), best]
        # posterior of the best over the others, as if so many characters were independent evidence
        weight = np.minimum(sizes, 40)[:, None]
        score = 1 / np.exp2(np.maximum((low[:, None] - h) * weight, -1000)).sum(axis=1)
        return [(self.langs[b], float(s), float(e), bool(e <= self.limits[b] + SLACK / n)) if n else (UNDETERMINED, 0.0, None, False) for b, s, e, n in zip(best, score, low, sizes, strict=True)]


_MODEL = T.StructType([T.StructField("lang", T.StringType()), T.StructField("n", T.IntegerType()), *[T.StructField(x, T.BinaryType()) for x in LEVEL], T.StructField("limit", T.DoubleType())])


def _fit(order: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        lang = pdf["lang"].iloc[0]
        counted = pdf[~pdf["calibrates"]]
        held = pdf[pdf["calibrates"]]
        levels = kneser_ney(list(counted["text"]), order)
        limit = float("inf")
        if len(held) and all(len(x[0]) for x in levels):
            h, sizes = Identifier({lang: levels}, {}, order).entropies(list(held["text"]))
            own = h[sizes >= 20, 0]
            if len(own):
                limit = float(np.quantile(own, QUANTILE)) * MARGIN
        rows = [(lang, n, *(a.tobytes() for a in level), limit) for n, level in enumerate(levels)]
        return pd.DataFrame(rows, columns=_MODEL.names)

    return fit


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, sample_docs: int = SAMPLE_DOCS) -> Identifier:
    """One model a language from a bounded sample of labelled rows; models are fitted on the executors, a language a task."""
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(F.length("text") <= SAMPLE_CHARS)
    share = {r["lang"]: min(1.0, sample_docs / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return Identifier({}, {}, order)
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    shares = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    sample = rows.where(draw < F.element_at(shares, F.col("lang"))).withColumn("calibrates", F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(5)) == 0)
    models: dict[str, list] = {}
    limits: dict[str, float] = {}
    for r in sorted(sample.groupBy("lang").applyInPandas(_fit(order), _MODEL).collect(), key=lambda r: (r["lang"], r["n"])):
        arrays = [np.frombuffer(bytes(r[c]), t) for c, t in LEVEL.items()]
        models.setdefault(r["lang"], []).append(tuple(arrays))
        limits[r["lang"]] = r["limit"]
    models = {x: m for x, m in models.items() if all(len(level[0]) for level in m)}
    return Identifier(models, limits, order)


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("accepted", T.BooleanType())])


def predict(df: DataFrame, model: Identifier, text_col: str = "text") -> DataFrame:
    """df with its text column replaced by the columns of PREDICTED. One narrow pass."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return arrow_map(df, lambda: shared.value.predict, text_col, PREDICTED, size=64)


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that training may read: crc32 of the id modulo 4 is not 2."""
    return docs.where(F.coalesce(remainder(id_col, 4) != 2, F.lit(True)))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out and the prediction of every row."""
    model = train(learnable(docs, id_col), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(remainder(id_col, 4) == 2, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, model)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose prediction is accepted, with their own columns."""
    model = train(learnable(docs, id_col), id_col, text_col, lang_col)
    judged = predict(packed(docs, judged_text=F.col(text_col)), model, "judged_text")
    return unpacked(judged.where("accepted"))
