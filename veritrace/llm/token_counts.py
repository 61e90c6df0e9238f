"""Token counts through a digest cache.

The cache is an append-only Parquet table (content digest, tokenizer digest, tokens). Contents are digested whole; a
digest that the cache lacks for this tokenizer is encoded once, however many rows hold it, and appended. Copies are
merged on the map side before texts are shuffled, so a text that a third of all rows hold is sent once a task.

Normalised content is the text with null as the empty text: anything more would change counts. The tokenizer's digest
covers its file and its library's version. Defined results: null and empty texts have 0 bytes and 0 tokens; ids may
repeat or be null; two runs that append the same digest at once do no harm.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterable

import public_tokenizers
import regex
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map

#: Pieces that one Python worker remembers; when it is full, it starts anew.
MEMO = 400_000

COUNT = T.StructType([T.StructField("n_tokens", T.LongType())])
CACHE = T.StructType([T.StructField("digest", T.StringType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())])

Counter = Callable[[list[str]], list[int]]


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer_digest(path: str) -> str:
    """sha256 of the library's name and version and the file."""
    import sentencepiece
    import tokenizers

    said = f"sentencepiece {sentencepiece.__version__}\n" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}\n"
    with open(path, "rb") as f:
        return hashlib.sha256(said.encode() + f.read()).hexdigest()


class PieceCounter:
    """Counts by the pieces into which a plain byte-level tokenizer splits a text before merging.

    Each piece is encoded on its own in any case, so the library's count of a piece is remembered and added up.
    """

    def __init__(self, tokenizer, specials: list[str]):
        self.tokenizer = tokenizer
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.memo: dict[str, int] = {}

    @staticmethod
    def fits(said: dict) -> bool:
        """Whether a tokenizer's settings split as PATTERN does and nothing else touches the text."""
        pre, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not said.get("normalizer")
        whole = model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
        simple = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in said.get("added_tokens", []))
        return bool(plain and whole and simple and not said.get("truncation") and not said.get("padding"))

    def pieces(self, text: str) -> Iterable[str]:
        if self.specials is None or self.specials.search(text) is None:
            return self.pattern.findall(text)
        return [p for part in self.specials.split(text) for p in self.pattern.findall(part)] + self.specials.findall(text)

    def __call__(self, texts: list[str]) -> list[int]:
        split = [self.pieces(t) for t in texts]
        new = list(set().union(*split).difference(self.memo))
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list(set().union(*split))
        self.memo.update(zip(new, (len(e.ids) for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        known = self.memo.__getitem__
        return [sum(map(known, p)) for p in split]


_loaded: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The library's counts for a tokenizer file: sentencepiece for .model, tokenizers else. One a worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.no_truncation()
            own.no_padding()
            with open(path, encoding="utf-8") as f:
                said = json.load(f)
            if PieceCounter.fits(said):
                _loaded[path] = PieceCounter(own, [t["content"] for t in said.get("added_tokens", [])])
            else:
                _loaded[path] = lambda texts: [len(e.ids) for e in own.encode_batch_fast(texts, add_special_tokens=False)]
    return _loaded[path]


def _stored(df: DataFrame, cache_dir: str, version: str) -> DataFrame | None:
    """The cache's counts for this tokenizer, one row a digest; None where there is no cache yet."""
    try:
        rows = df.sparkSession.read.schema(CACHE).parquet(cache_dir)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(docs: DataFrame, cache_dir: str, text_col: str = "text", path: str | None = None) -> None:
    """Encode the contents that the cache lacks, each once, and append their counts."""
    path = path or default_path()
    version = tokenizer_digest(path)
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    distinct = texts.select(F.sha2("text", 256).alias("digest"), "text").dropDuplicates(["digest"])
    known = _stored(docs, cache_dir, version)
    misses = distinct if known is None else distinct.join(known, "digest", "left_anti")
    counted = arrow_map(misses, lambda: lambda values, c=counter(path): [(n,) for n in c(values)], "text", COUNT, size=64)
    counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_dir)


def token_counts(docs: DataFrame, cache_dir: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) and digest of every row."""
    path = path or default_path()
    fill_cache(docs, cache_dir, text_col, path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("digest"))
    counts = _stored(docs, cache_dir, tokenizer_digest(path))
    return rows.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "digest")
