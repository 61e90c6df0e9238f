"""Byte-level BPE: exact encoding in linear time and decoding.

Bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton over the vocabulary can read them. A piece is
first covered greedily by leftmost-longest matches; where two neighbours are not compatible it is encoded by
backtracking: longest match first, then shorter ones, then back one token. A position once given up never begins a
token again, so the work is linear. Two neighbours are compatible if merging their joined bytes would give just the
two: each token is a merge tree, only the right edge of the left tree and the left edge of the right tree meet, and a
pair of edge nodes would merge if its rank comes up while both exist. The answers are memoised.

Defined results: null text is the empty text; the empty text has no tokens. Special strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array

import ahocorasick
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map

#: Pieces and pairs that one Python worker remembers; when it is full, it starts anew.
MEMO = 400_000

NEVER = 1 << 60


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.data = {i: t for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(i) for t, i in map(bytes.split, f)})

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte.

        Merging the token's bytes by every lower rank leaves two parts, since the token's own merge is the last.
        """
        if token not in self._parts:
            if len(self.data[token]) == 1:
                self._parts[token] = None
            else:
                found = self._merged([bytes((b,)) for b in self.data[token]], token)
                if len(found) != 2:
                    raise ValueError(f"token {token} is not made of two lower ones")
                self._parts[token] = self.ranks[found[0]], self.ranks[found[1]]
        return self._parts[token]

    def _merged(self, parts: list[bytes], below: int) -> list[bytes]:
        """Plain merging, lowest rank first, leftmost first, by ranks under `below`."""
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: int, side: int, memo: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int]]:
        """(node, rank at which it is merged away) along one edge of the token's tree, from the token down."""
        if token not in memo:
            nodes, gone, node = [], NEVER, token
            while True:
                nodes.append((node, gone))
                p = self.parts(node)
                if p is None:
                    break
                gone, node = node, p[side]
            memo[token] = nodes
        return memo[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b, joined and merged, stay these two tokens."""
        known = self._pairs.get((a, b))
        if known is None:
            known = True
            ranks, data = self.ranks, self.data
            for x, x_gone in self._edge(a, 1, self._right):
                for y, y_gone in self._edge(b, 0, self._left):
                    # at equal ranks the leftmost merge goes first: x's own before this one, this one before y's
                    rank = ranks.get(data[x] + data[y], NEVER)
                    if rank < x_gone and rank <= y_gone and rank != NEVER:
                        known = False
                        break
                if not known:
                    break
            if len(self._pairs) >= MEMO:
                self._pairs.clear()
            self._pairs[a, b] = known
        return known

    def _backtrack(self, piece: str) -> list[int]:
        """The tokens of a piece of Latin-1 characters, by longest match first."""
        n = len(piece)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, token in self.automaton.iter(piece):
            size = len(self.data[token])
            starts[end + 1 - size].append((size, token))  # in order of ends, so the longest comes last
        out: list[int] = []
        at, left = 0, list(starts[0])
        stack: list[list[tuple[int, int]]] = []  # what is left to try where each token of `out` begins
        dead = bytearray(n + 1)
        while at < n:
            while left:
                size, token = left.pop()
                if not dead[at + size] and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    stack.append(left)
                    at += size
                    left = list(starts[at]) if at < n else []
                    break
            else:
                dead[at] = 1
                if not out:
                    raise ValueError("the vocabulary does not cover all bytes")
                at -= len(self.data[out.pop()])
                left = stack.pop()
        return out

    def encode_piece(self, raw: bytes) -> list[int]:
        piece = raw.decode("latin-1")
        greedy = [token for _, token in self.automaton.iter_long(piece)]
        before = -1
        for token in greedy:
            if before >= 0 and not self.compatible(before, token):
                return self._backtrack(piece)
            before = token
        return greedy

    def _remember(self, piece: str) -> bytes:
        ids = array("I", self.encode_piece(piece.encode("utf-8")))
        if ids.itemsize != 4:
            raise SystemError("ids need four bytes")
        if sys.byteorder == "big":
            ids.byteswap()
        raw = ids.tobytes()
        if len(self._pieces) >= MEMO:
            self._pieces.clear()
        if len(piece) <= 64:
            self._pieces[piece] = raw
        return raw

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        known, fresh = self._pieces.get, self._remember
        return b"".join([known(p) or fresh(p) for p in self.pattern.findall(text)])

    def encode(self, text: str) -> list[int]:
        return list(memoryview(self.encode_bytes(text)).cast("I"))

    def decode_bytes(self, ids: bytes) -> bytes:
        """The bytes that little-endian ids stand for."""
        return b"".join(map(self.data.__getitem__, memoryview(ids).cast("I")))


_loaded: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    """One tokenizer a worker and file; its memo is kept between tasks."""
    if path not in _loaded:
        _loaded[path] = ByteBpe.load(path)
    return _loaded[path]


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
DECODED = T.StructType([T.StructField("decoded", T.BinaryType())])


def encode_column(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """df with its text column replaced by the array of token ids."""
    path = path or default_path()
    return arrow_map(df, lambda: lambda values, t=tokenizer(path): [(t.encode(v or ""),) for v in values], text_col, ENCODED)


def decode_column(df: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """df with its column of token ids replaced by the bytes they stand for (null: empty)."""
    path = path or default_path()
    return arrow_map(df, lambda: lambda values, t=tokenizer(path): [(t.decode_bytes(array("I", v or []).tobytes()),) for v in values], ids_col, DECODED)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each whole text encoded and decoded again: doc_id, the columns of DIGESTS and those to `keep`. One narrow pass. A
    null text is the empty one; rows may repeat, and their ids may be null."""
    path = path or default_path()

    def each():
        t = tokenizer(path)

        def work(values: list) -> list[tuple]:
            out = []
            for v in values:
                ids = t.encode_bytes(v or "")
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.decode_bytes(ids)).hexdigest()))
            return out

        return work

    kept = [F.col(f"`{c}`") for c in keep if c not in ("doc_id", *DIGESTS.names)]
    read = "_" + max((*keep, "read"), key=len)  # longer than any other name
    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), *kept, F.col(text_col).alias(read)), each, read, DIGESTS, size=64)
