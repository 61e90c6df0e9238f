"""Language-model scoring with an n-gram trie in Elias-Fano coded levels.

The trie has two levels below its root. The first holds the hashes of all words as a monotone sequence; a word's rank
is its id. Monotone pointers lead to a context's children on the second level, whose ids are made monotone over the
whole level by adding the last value of the context before (context-relative coding), so that one successor search
finds a child. Beside them stand quantised log probabilities, and counts. Both levels come in shards (by hash, by
context), each a file in the shared folder that scoring tasks memory-map: heap holds none of the model.

Probabilities: a bigram takes its count less a discount, over its context's count; what is discounted goes to the word
probabilities; words share what Good and Turing leave them beside one unknown word. log10 throughout; bigram values are
kept to 1/256.

Counting goes in sorted runs: a task counts its part with sorted arrays and sends each shard a compressed run, and a
shard's task merges them; nothing is counted on the driver, and no run grows with the input.

Lookups visit one shard after another, and a visit costs about the same for one word as for a hundred. So texts are
looked up RUN_BYTES or a whole Arrow batch at a time: the number of shards grows with the input, and with small groups of
texts the visits would grow with its square.

Defined results: null text is the empty text, which has its end only; rows may repeat; null ids count as learned from;
with nothing to learn from every count is 0, the base is that of an empty count and the score is 0.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, bounded, freed, remainder, shared_folder
from .elias_fano import EliasFano, mapped, to_bytes

DISCOUNT = 0.75
STEPS = 256  # quantisation steps to 1 of log10
SHARD_BYTES = 24_000_000  # text to a shard
RUN_BYTES = 8 << 20  # text counted to a run
BATCH_ROWS = 1 << 14  # texts scored at once, fewer where an Arrow batch ends by bytes
END = (1 << 64) - 1  # the hash that stands for the end of a text


class _Numbers(dict):
    """Words numbered in the order they come."""

    def __missing__(self, word: bytes | None) -> int:
        self[word] = n = len(self)
        return n


def _tokens(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts the sorted 64-bit hashes of their different tokens (words, ASCII case folded, split at ASCII white space, and
    the end), which of them each token is, and the number of tokens by text."""
    numbers, streams = _Numbers(), []
    end = numbers[None]
    for raw in texts:
        words = (raw or b"").lower().split()
        stream = np.full(len(words) + 1, end, np.int64)
        stream[:-1] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        streams.append(stream)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.array([END if w is None else digest(w) for w in numbers], np.uint64)
    distinct, rank = np.unique(hashes, return_inverse=True)
    return distinct, rank[np.concatenate(streams)], np.array([len(x) for x in streams])


def _packed_run(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences and their counts, compressed."""
    steps = np.diff(keys, prepend=np.zeros(1, keys.dtype))
    body = np.array([len(keys)], np.int64).tobytes() + steps.tobytes() + counts.astype(np.uint32).tobytes()
    return zstandard.compress(body, 1)


def _merged_runs(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All runs' distinct keys, sorted, and the sums of their counts."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for run in runs:
        body = zstandard.decompress(run)
        n = int(np.frombuffer(body, np.int64, 1)[0])
        keys.append(np.cumsum(np.frombuffer(body, np.uint64, n, 8)))
        counts.append(np.frombuffer(body, np.uint32, n, 8 + 8 * n))
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(all_keys, kind="stable")
    all_keys = all_keys[order]
    first = np.flatnonzero(np.diff(all_keys, prepend=all_keys[:1] ^ np.uint64(1)))
    sums = np.add.reduceat(all_counts[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return all_keys[first], sums


_RUN = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("run", T.BinaryType())])


def _runs(texts: DataFrame, counted: Callable[[list], tuple[np.ndarray, np.ndarray]], shard_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(shard, run) of the sorted keys and their counts that counted() makes of texts; shard_of() must not fall as keys rise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, counts = counted(held)
            held.clear()
            shards, first = np.unique(shard_of(keys), return_index=True)
            ends = [*first[1:], len(keys)]
            packed = [_packed_run(keys[a:b], counts[a:b]) for a, b in zip(first, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), pa.array(packed, pa.binary())], ["shard", "run"])

        for batch in batches:
            for raw in batch.column(0).cast(pa.binary()).to_pylist():
                held.append(raw)
                size += len(raw or b"") + 16
                if size >= RUN_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()
        freed()

    bounded(texts)
    return texts.mapInArrow(run, _RUN)


def _put(folder: str, name: str, data: bytes) -> None:
    """A file in the shared folder; a task that runs twice puts the same bytes, the last rename stands."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(own) as f:
        f.write(data)
    system.move(own, f"{path}/{name}")


def _map(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file in the shared folder, memory-mapped; from a remote store by way of an unlinked local file."""
    system, path = fs.FileSystem.from_uri(folder)
    if isinstance(system, fs.LocalFileSystem):
        return mapped(f"{path}/{name}")
    with tempfile.NamedTemporaryFile() as f, system.open_input_stream(f"{path}/{name}") as source:
        while part := source.read(1 << 22):
            f.write(part)
        f.flush()
        return mapped(f.name)


@dataclass(frozen=True)
class Model:
    """What describes a trie in the shared folder: small, sent to every task."""

    folder: str
    bits: int  # of a hash that choose a shard
    bases: tuple[int, ...]  # id of each shard's first word, and the number of words
    tokens: int
    hapax: int

    @property
    def types(self) -> int:
        return self.bases[-1]

    def shard_of_hash(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def shard_of_id(self, ids: np.ndarray) -> np.ndarray:
        """Contexts are words or, with the last id, the begin."""
        return np.minimum(np.searchsorted(np.array(self.bases), ids, "right") - 1, len(self.bases) - 2)

    def log_word(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the word probabilities by count."""
        unknown = max(self.hapax, 1) / (self.tokens + 1) if self.tokens else 1.0
        return np.where(counts > 0, np.log10(np.maximum(counts, 1) / max(self.tokens, 1) * (1 - unknown)), np.log10(unknown))


class Words:
    """The first level of the trie, shard by shard."""

    def __init__(self, model: Model):
        self.model = model
        self.shards: dict[int, tuple[EliasFano, np.ndarray]] = {}

    def _shard(self, s: int) -> tuple[EliasFano, np.ndarray]:
        if s not in self.shards:
            arrays = _map(self.model.folder, f"words-{s}")
            self.shards[s] = EliasFano.read(arrays, "hash"), arrays["count"]
        return self.shards[s]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted distinct hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        edges = np.searchsorted(self.model.shard_of_hash(hashes), np.arange(len(self.model.bases)))
        for s in np.flatnonzero(np.diff(edges)):
            if self.model.bases[s + 1] == self.model.bases[s]:
                continue
            keys, known = self._shard(int(s))
            part = slice(edges[s], edges[s + 1])
            at = keys.find(hashes[part])
            ids[part] = np.where(at >= 0, at + self.model.bases[s], -1)
            counts[part] = np.where(at >= 0, known[np.maximum(at, 0)], 0)
        return ids, counts


class Bigrams:
    """The second level: children by context."""

    def __init__(self, model: Model):
        self.model = model
        self.shards: dict[int, tuple[EliasFano, EliasFano, np.ndarray, np.ndarray]] = {}

    def _shard(self, s: int) -> tuple[EliasFano, EliasFano, np.ndarray, np.ndarray]:
        if s not in self.shards:
            arrays = _map(self.model.folder, f"bigrams-{s}")
            self.shards[s] = EliasFano.read(arrays, "pointer"), EliasFano.read(arrays, "child"), arrays["logp"], arrays["backoff"]
        return self.shards[s]

    def find(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of known words after known contexts (nan where the pair is unseen), and the contexts'
        back-off; contexts sorted."""
        logp, backoff = np.full(len(contexts), np.nan), np.zeros(len(contexts))
        shards = self.model.shard_of_id(contexts)
        edges = np.searchsorted(shards, np.arange(len(self.model.bases)))
        for s in np.flatnonzero(np.diff(edges)):
            pointer, child, p, b = self._shard(int(s))
            part = slice(edges[s], edges[s + 1])
            own = contexts[part] - self.model.bases[s]
            begin = pointer.access(own).astype(np.int64)
            before = np.where(begin > 0, child.access(np.maximum(begin - 1, 0)), 0) if child.n else np.zeros(len(own), np.uint64)
            # a child of this context lies over the last value of the one before, by its id and one
            at = child.find(before + words[part].astype(np.uint64) + np.uint64(1))
            end = pointer.access(own + 1).astype(np.int64)
            hit = (at >= begin) & (at < end)
            logp[part] = np.where(hit, -p[np.maximum(at, 0)].astype(np.float64) / STEPS if len(p) else np.nan, np.nan)
            backoff[part] = -b[own].astype(np.float64) / STEPS
        return logp, backoff


_STATS = T.StructType([T.StructField(x, T.LongType()) for x in ("shard", "types", "tokens", "hapax")])


def _write_words(folder: str):
    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        keys, counts = _merged_runs(list(pdf["run"]))
        kept = counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64)
        _put(folder, f"words-{shard}", to_bytes(EliasFano.of(keys, 1 << 64).arrays("hash") | {"count": kept}))
        return pd.DataFrame([(shard, len(keys), int(counts.sum()), int((counts == 1).sum()))], columns=_STATS.names)

    return write


def _quantised(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-logs * STEPS), 0, 65535).astype(np.uint16)


def _write_bigrams(model: Model):
    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        keys, counts = _merged_runs(list(pdf["run"]))
        contexts, words = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        base, top = model.bases[shard], model.bases[shard + 1] + (shard == len(model.bases) - 2)
        start = np.searchsorted(contexts, np.arange(base, top + 1))
        children = np.diff(start)
        total = np.bincount(contexts - base, counts, top - base)
        left = np.where(children > 0, DISCOUNT * children / np.maximum(total, 1), 1.0)
        used, which = np.unique(words, return_inverse=True)
        of_word = np.concatenate([np.zeros(0)] + [10 ** model.log_word(c) for c in [_counts_of(model, used)]])[which]
        where = contexts - base
        p = (counts - DISCOUNT) / total[where] + left[where] * of_word
        # context-relative: each context's children lie over the last child of the context before
        last = np.zeros(top - base, np.uint64)
        full = children > 0
        last[full] = (words[start[1:][full] - 1] + 1).astype(np.uint64)
        offset = np.concatenate(([0], np.cumsum(last)))[:-1].astype(np.uint64)
        values = offset[where] + words.astype(np.uint64) + np.uint64(1)
        universe = int(values[-1]) + 1 if len(values) else 1
        arrays = EliasFano.of(start.astype(np.uint64), len(keys) + 1).arrays("pointer") | EliasFano.of(values, universe).arrays("child")
        _put(model.folder, f"bigrams-{shard}", to_bytes(arrays | {"logp": _quantised(np.log10(p)), "backoff": _quantised(np.log10(left))}))
        return pd.DataFrame([(shard, len(keys), int(counts.sum()), 0)], columns=_STATS.names)

    return write


def _counts_of(model: Model, ids: np.ndarray) -> np.ndarray:
    """Counts of sorted word ids, from the mapped first level."""
    own, counts = Words(model), np.zeros(len(ids), np.int64)
    edges = np.searchsorted(ids, np.array(model.bases))
    for s in np.flatnonzero(np.diff(edges)):
        part = slice(edges[s], edges[s + 1])
        counts[part] = own._shard(int(s))[1][ids[part] - model.bases[s]]
    return counts


def _batch(words: Words, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of texts: ids, counts, and the number of tokens by text."""
    distinct, which, sizes = _tokens(texts)
    ids, counts = words.find(distinct)
    return ids[which], counts[which], sizes


def _contexts(ids: np.ndarray, sizes: np.ndarray, begin: int) -> np.ndarray:
    """Each token's context: the id before it, or the begin."""
    before = np.concatenate(([begin], ids[:-1]))
    before[np.cumsum(sizes)[:-1]] = begin
    return before


def train(rows: DataFrame, text_col: str = "text") -> Model:
    """Count all rows and write the trie to the shared folder."""
    texts = rows.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (int(size) // SHARD_BYTES).bit_length())
    folder = f"{shared_folder(rows.sparkSession)}/ngrams-{uuid.uuid4().hex}"
    plain = Model(folder, bits, (0,) * ((1 << bits) + 1), 0, 0)

    def words_of(t: list) -> tuple[np.ndarray, np.ndarray]:
        distinct, which, _ = _tokens(t)
        return distinct, np.bincount(which, minlength=len(distinct))

    runs = _runs(texts, words_of, plain.shard_of_hash)
    stats = {r["shard"]: r for r in runs.groupBy("shard").applyInPandas(_write_words(folder), _STATS).collect()}
    bases = np.concatenate(([0], np.cumsum([stats[s]["types"] if s in stats else 0 for s in range(1 << bits)])))
    model = Model(folder, bits, tuple(bases.tolist()), sum(r["tokens"] for r in stats.values()), sum(r["hapax"] for r in stats.values()))
    if not model.tokens:
        return model
    if model.types >= 1 << 32:
        raise ValueError("more than 2^32 distinct words: ids no longer fit half a key")
    opened: list[Words] = []

    def pairs(t: list) -> tuple[np.ndarray, np.ndarray]:
        if not opened:
            opened.append(Words(model))
        ids, _, sizes = _batch(opened[0], t)
        return np.unique(_contexts(ids, sizes, model.types).astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64), return_counts=True)

    runs = _runs(texts, pairs, lambda keys: model.shard_of_id((keys >> np.uint64(32)).astype(np.int64)))
    # every shard is written, for contexts without children too: an empty run each
    empty = rows.sparkSession.createDataFrame([(s, _packed_run(np.zeros(0, np.uint64), np.zeros(0, np.uint32))) for s in range(1 << bits)], _RUN)
    runs.union(empty).groupBy("shard").applyInPandas(_write_bigrams(model), _STATS).collect()
    return model


SCORES = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
    T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
])


def _scorer(model: Model):
    def each():
        words, bigrams = Words(model), Bigrams(model)

        def work(texts: list) -> list[tuple]:
            ids, counts, sizes = _batch(words, texts)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            base = np.log10((counts + 1) / (model.tokens + model.types + 1))
            value = model.log_word(counts)
            if model.tokens:
                contexts = _contexts(ids, sizes, model.types)
                at = np.flatnonzero(contexts >= 0)
                # each distinct pair once; an unknown word has no pair but pays the back-off
                pairs, which = np.unique(contexts[at].astype(np.uint64) << np.uint64(32) | (ids[at] + 1).astype(np.uint64), return_inverse=True)
                own, word = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64) - 1
                logp, backoff = bigrams.find(own, np.maximum(word, 0))
                logp[word < 0] = np.nan
                value[at] = np.where(np.isnan(logp[which]), value[at] + backoff[which], logp[which])
            known = np.add.reduceat((counts > 0).astype(np.int64), starts)
            return list(zip(sizes.tolist(), known.tolist(), [model.tokens] * len(texts), np.add.reduceat(base, starts).tolist(), np.add.reduceat(value, starts).tolist(), strict=True))

        return work

    return each


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with its text column replaced by the columns of SCORES. One narrow pass."""
    return arrow_map(df, _scorer(model), text_col, SCORES, binary=True, size=BATCH_ROWS)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out and SCORES of every row, by a model of the rows whose crc32 of the id modulo 7 is not 2."""
    held = F.coalesce(remainder(id_col, 7) == 2, F.lit(False))
    model = train(docs.where(~held), text_col)
    return score(docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text")), model)
