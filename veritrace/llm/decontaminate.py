"""Benchmark decontamination: a BM25 index of test items, searched block by block, and verified overlaps.

Items are dealt to classes by their number of words, each at most twice as many as the least of its class. For each class
every training text is cut into passages of twice its longest item, half overlapping, so any copy of an item lies whole
in one, and one long item widens no other's passages. A passage is a query: an item's score is the share of its own BM25 weight that the passage's distinct words
carry, from 0 to 1, and all items at or over the threshold are retrieved. Postings stand in blocks of items with the
largest weight a word has in each (block-max): only blocks whose maxima add up to the threshold are scored. The same
bound over all words of a text skips the passages of texts that cannot hold any item.

Retrieved items are verified: the words of the question and of the answer must stand in order, to the given share each
(longest common subsequence), within a span of SPAN times the item's words. The answer is an item's last sentence, where it has several. Items of
fewer than SHORT words must stand word for word.

The index is broadcast in blocks of at most BLOCK_CHARS characters of items, one pass over the texts each.

Defined results: null or wordless texts and items match nothing; equal items and rows each match on their own; case,
punctuation and white space don't matter; one row for each text and item, the passage of the highest score, first on ties.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, packed, unpacked

K1, B = 1.2, 0.75
BLOCK = 16  # items to a block of postings
THRESHOLD = 0.6
OVERLAP = 0.8
SHORT = 8
SPAN = 1.5
BLOCK_CHARS = 16_000_000

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit of one integer a word of a."""
    full = (1 << len(a)) - 1
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    state = full
    for w in b:
        m = at.get(w)
        if m:
            u = state & m
            state = (state + u | state - u) & full
    return len(a) - state.bit_count()


class ItemIndex:
    """Weights by word and item, normalised so that an item's own text scores 1. frequencies: in how many items a word
    stands, and of how many, where these are a class of more."""

    def __init__(self, items: list[tuple[int, str]], frequencies: tuple[dict[str, int], int] | None = None):
        split = [(key, words_of(text), text) for key, text in items]
        split = [x for x in split if x[1]]
        self.keys = [x[0] for x in split]
        self.words = [x[1] for x in split]
        self.parts = [self._question(text) for _, _, text in split]
        self.longest = max(map(len, self.words), default=1)
        self.vocab: dict[str, int] = {}
        rows: list[tuple[int, int, int]] = []
        for i, own in enumerate(self.words):
            counts: dict[str, int] = {}
            for w in own:
                counts[w] = counts.get(w, 0) + 1
            rows += [(self.vocab.setdefault(w, len(self.vocab)), i, n) for w, n in counts.items()]
        term, item, tf = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
        n, df, total = len(split), np.bincount(term, minlength=len(self.vocab)), len(split)
        if frequencies:
            known, total = frequencies
            df = np.array([known[w] for w in self.vocab], np.int64)
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
        sizes = np.array([len(w) for w in self.words], np.float64)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[item] / max(sizes.mean() if n else 1, 1)))
        weight /= np.bincount(item, weight, n)[item]
        order = np.lexsort((item, term))
        term, self.item, self.weight = term[order], item[order], weight[order]
        self.start = np.searchsorted(term, np.arange(len(self.vocab) + 1))
        blocks = self.item // BLOCK
        first = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(blocks, prepend=-1)) if len(term) else np.zeros(0, np.int64)
        self.block = blocks[first]
        self.block_max = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.block_start = np.searchsorted(term[first], np.arange(len(self.vocab) + 1))
        self.n_blocks = -(-n // BLOCK)

    @staticmethod
    def _question(text: str) -> tuple[list[str], list[str]]:
        sentences = [s for s in (words_of(x) for x in _SENTENCE.split(text)) if s]
        if len(sentences) < 2:
            return sentences[0], []
        return [w for s in sentences[:-1] for w in s], sentences[-1]

    @staticmethod
    def _ranges(start: np.ndarray, terms: np.ndarray) -> np.ndarray:
        low, size = start[terms], start[terms + 1] - start[terms]
        return np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)

    def retrieve(self, terms: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """(item, score) of all items that distinct terms score at or over the threshold."""
        need = threshold - 1e-9
        at = self._ranges(self.block_start, terms)
        bound = np.bincount(self.block[at], self.block_max[at], self.n_blocks)
        alive = bound >= need
        if not alive.any():
            return []
        at = self._ranges(self.start, terms)
        at = at[alive[self.item[at] // BLOCK]]
        score = np.bincount(self.item[at], self.weight[at], len(self.keys))
        return [(int(i), float(score[i])) for i in np.flatnonzero(score >= need)]

    def verify(self, item: int, passage: list[str]) -> tuple[float, float] | None:
        """Shares of the question and of the answer that the passage holds, or None where they are too low."""
        own = self.words[item]
        if len(own) < SHORT:
            exact = f" {' '.join(own)} " in f" {' '.join(passage)} "
            return (1.0, 1.0) if exact else None
        question, answer = self.parts[item]
        if common_subsequence(question, passage) < OVERLAP * len(question) or common_subsequence(answer, passage) < OVERLAP * len(answer):
            return None
        size, best = int(SPAN * len(own)) + 1, None
        for at in range(0, max(1, len(passage) - size + 1) + 1, max(1, len(own) // 8)):
            span = passage[at : at + size]
            q = common_subsequence(question, span) / len(question)
            a = common_subsequence(answer, span) / len(answer) if answer else 1.0
            if q >= OVERLAP and a >= OVERLAP and (best is None or (q, a) > best):
                best = q, a
        return best

    def search_words(self, words: list[str], distinct: set[str], threshold: float = THRESHOLD) -> list[tuple[int, float, float, float, int]]:
        """(item, score, question overlap, answer overlap, first word of the passage) of each verified item."""
        vocab = self.vocab
        known = np.array([vocab[w] for w in vocab.keys() & distinct], np.int64)
        if not len(known) or not self.retrieve(known, threshold):
            return []
        ids = np.array([vocab.get(w, -1) for w in words], np.int64)
        best: dict[int, tuple[int, float, float, float, int]] = {}
        for at in range(0, max(1, len(words) - self.longest), self.longest):
            terms = np.unique(ids[at : at + 2 * self.longest])
            terms = terms[terms >= 0]
            for item, score in self.retrieve(terms, threshold) if len(terms) else ():
                if item in best and best[item][1] >= score:
                    continue
                found = self.verify(item, words[at : at + 2 * self.longest])
                if found:
                    best[item] = (item, score, *found, at)
        return [best[i] for i in sorted(best)]


class ItemClasses:
    """Items by length: class k has those of 2^k to 2^(k+1) - 1 words, word frequencies are of all items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.classes: list[ItemIndex] = []
        counts, by_size, total = {}, {}, 0
        for key, text in items:
            own = words_of(text)
            if own:
                total += 1
                by_size.setdefault(len(own).bit_length(), []).append((key, text))
                for w in set(own):
                    counts[w] = counts.get(w, 0) + 1
        self.classes = [ItemIndex(by_size[k], (counts, total)) for k in sorted(by_size)]

    def search(self, text: str | None, threshold: float = THRESHOLD) -> list[tuple]:
        """(item_id, score, question overlap, answer overlap, first word of the passage) of each verified item."""
        words = words_of(text)
        distinct = set(words)
        return [(own.keys[hit[0]], *hit[1:]) for own in self.classes for hit in own.search_words(words, distinct, threshold)]


_HIT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType()), T.StructField("first_word", T.LongType())])
HITS = T.StructType([T.StructField("hits", T.ArrayType(_HIT, False))])


def _indexes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterable[ItemClasses]:
    """Indexes over blocks of items whose texts have at most BLOCK_CHARS characters in expectation."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        yield ItemClasses(sorted(((r["id"], r["text"]) for r in part.collect()), key=lambda r: (r[1], str(r[0]))))


def _searched(df: DataFrame, index: ItemClasses, text_col: str, threshold: float) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(index)

    def each():
        own = shared.value
        return lambda texts: [([dict(zip(_HIT.names, h, strict=True)) for h in own.search(t, threshold)],) for t in texts]

    return arrow_map(df, each, text_col, HITS)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each text and test item that it holds: doc_id and the fields of a hit."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for index in _indexes(benchmark, item_col, item_text_col):
        part = _searched(rows, index, "text", threshold).select("doc_id", F.inline("hits"))
        found = part if found is None else found.union(part)
    if found is None:
        found = rows.where(F.lit(False)).select("doc_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in _HIT.fields])
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that hold no test item, with their own columns. One narrow pass a block of items."""
    for index in _indexes(benchmark, item_col, item_text_col):
        judged = _searched(packed(docs, own_text=F.col(text_col)), index, "own_text", threshold)
        docs = unpacked(judged.where(F.size("hits") == 0))
    return docs
