"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint of 64 bits has eight (position, byte) entries. Two that differ in at most two bits differ in at most two
bytes, so they share at least six entries: that is the guaranteed minimum of matches. Lists of single entries would
hold a 256th of all fingerprints each, and tallying their pairs would grow with the square of the input; so the index
keeps, for each of the 28 ways to choose six positions, the lists of fingerprints that share those six entries. A pair
stands in one of them if and only if its tally reaches six. Within a list the two other bytes decide, and what is
verified is the number of differing bits.

Equal fingerprints are merged first, so a list holds at most 65,536 different ones however many copies there are, and
a list gives no pairs but a star for each connected group in it: rows out never exceed rows in.

Defined results: null text is the empty text; texts without a word have fingerprint zero and are linked like any
others; rows may repeat; ids may be null (a component's id is its smallest id that is not null).

keep_similar() is the corpus stage: texts are near copies where the Jaccard similarity of their five-word shingles is at
least 0.8. The SimHashes of these shingles go through the same index, and texts that it connects are candidates. Pairs
near 0.8 differ in ten bits and more, so that no byte need be equal and a count filter guarantees nothing; texts that
share a MinHash band (at 0.8 all but 5 pairs in 100,000 do) are candidates, too. All are verified by the true similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, bounded, forget, materialize, packed, unpacked
from .components import components, local_components
from .linking import linked
from .minhash import band_keys

SHINGLE = 3
SEED = 42
BITS = 2
BYTES = 8
SMALL = 256  # lists up to this length are compared pair by pair
PART = 1 << 16  # shingles counted at once

STAGE_SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
TILE = 2000  # members of a slice of a list
REMEMBERED = 64  # texts whose shingles a task keeps,
KEPT = 1 << 21  # and shingles it keeps for a group's pairs

FINGERPRINT = T.StructType([T.StructField("fp", T.LongType())])


def shingle_hashes(raw: bytes | None, shingle: int = SHINGLE) -> list[int]:
    """Hashes of all word shingles, of all words where they are fewer, none where there is no word. ASCII case is folded."""
    words = (raw or b"").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    digest, starts = xxhash.xxh64_intdigest, [0, *ends[: len(words) - shingle]]
    return [digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[shingle - 1 :], strict=True)]


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the hashes of all word shingles, as a signed 64-bit integer."""
    return majority(shingle_hashes(raw, shingle))


def majority(hashes: list[int]) -> int:
    """The bits that over half the hashes have, as a signed 64-bit integer; zero if there are none."""
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PART):
        part = np.array(hashes[at : at + PART], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def postings(fp: Column, bits: int = BITS) -> Column:
    """A key for each choice of the BYTES - bits positions that are shared; the choice's number stands in a free byte."""
    keys = []
    for i, free in enumerate(combinations(range(BYTES), bits)):
        mask = (1 << 64) - 1
        for p in free:
            mask ^= 0xFF << 8 * p
        mark = i << 8 * free[0]
        keys.append(fp.bitwiseAND(F.lit(_signed(mask))).bitwiseOR(F.lit(_signed(mark))))
    return F.array(*keys)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_pairs(values: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of different unsigned values with at most `bits` differing bits."""
    if len(values) <= SMALL:
        i, j = np.triu_indices(len(values), 1)
        near = np.bitwise_count(values[i] ^ values[j]) <= bits
        return i[near], j[near]
    varying = int(np.bitwise_or.reduce(values ^ values[0]))
    places = [np.uint64(1 << b) for b in range(64) if varying >> b & 1]
    order = np.argsort(values)
    ranked, left, right = values[order], [], []
    for n in range(1, bits + 1):
        for chosen in combinations(places, n):
            turned = ranked ^ np.bitwise_or.reduce(chosen)
            at = np.minimum(np.searchsorted(ranked, turned), len(ranked) - 1)
            hit = np.flatnonzero((ranked[at] == turned) & (ranked < turned))
            left.append(order[hit])
            right.append(order[at[hit]])
    return np.concatenate(left), np.concatenate(right)


_STARS = T.StructType([T.StructField("stars", T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])))])


def _stars(bits: int):
    def work(lists: list) -> list[tuple]:
        out = []
        for members in lists:
            values = np.array(members, np.int64).view(np.uint64)
            label = local_components(len(values), *close_pairs(values, bits))
            signed = values.view(np.int64)
            out.append(([{"a": int(signed[x]), "b": int(signed[label[x]])} for x in np.flatnonzero(label != np.arange(len(label)))],))
        return out

    return work


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): edges that connect just the fingerprints which chains of links connect. fps: distinct `fp`."""
    lists = fps.select("fp", F.explode(postings(F.col("fp"), bits)).alias("key")).groupBy("key").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    return arrow_map(lists.select("members"), lambda: _stars(bits), "members", _STARS).select(F.inline("stars"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row. One narrow pass."""
    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), lambda: lambda values: [(fingerprint(v),) for v in values], "text", FINGERPRINT, binary=True)


def clusters(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, component_id) for the distinct fingerprints of fps (doc_id, fp)."""
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(nodes.select("fp"), bits)).withColumnRenamed("node", "fp")
    rooted = materialize(nodes.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "rooted")
    return rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id", "root")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    return fps.join(clusters(fps, bits), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest id, with its own columns."""
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    grouped = clusters(fps, bits)
    # the row to stay: of the smallest id, then of the smallest fingerprint
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("fp"))
    stay = fps.join(grouped, "fp").groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.doc_id").alias("stay_id"), F.col("o.fp").alias("stay_fp"))
    rows = arrow_map(packed(docs, own_id=F.col(id_col), own_text=F.col(text_col)), lambda: lambda values: [(fingerprint(v),) for v in values], "own_text", FINGERPRINT, binary=True)
    kept = rows.join(stay, (F.col("fp") == F.col("stay_fp")) & F.col("own_id").eqNullSafe(F.col("stay_id")))
    return unpacked(kept.dropDuplicates(["own_id", "fp"]))


_SKETCH = T.StructType([T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def text_sketches(texts: list, shingle: int = STAGE_SHINGLE) -> list[tuple[int, list[int]]]:
    """SimHash and band keys of the shingles of each text; texts without a word share theirs."""
    sets = [shingle_hashes(t, shingle) for t in texts]
    bands = band_keys(np.array([h for s in sets for h in s or [0]], np.uint64), np.array([len(s or [0]) for s in sets], np.int64), BANDS, ROWS)
    return list(zip(map(majority, sets), bands.tolist(), strict=True))


def alike(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two sets, as sorted arrays, have at least the Jaccard similarity."""
    few, many = sorted((len(a), len(b)))
    both = len(np.intersect1d(a, b, assume_unique=True)) if few >= least * many - 1e-9 else 0
    return both >= least * (few + many - both) - 1e-9


def _similar(shingle: int, least: float):
    """Pairs of texts that are alike. The sets of the last REMEMBERED texts are kept: many pairs have one in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}

        def of(key: int, text: str) -> np.ndarray:
            if key not in sets:
                if len(sets) >= REMEMBERED:
                    sets.clear()
                sets[key] = np.unique(np.array(shingle_hashes(text.encode("utf-8", "replace"), shingle), np.uint64))
            return sets[key]

        for batch in batches:
            a, b, left, right = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "left", "right"))
            keys = zip(a.to_pylist(), b.to_pylist(), strict=True)
            ok = pa.array([alike(of(x, left[n].as_py()), of(y, right[n].as_py()), least) for n, (x, y) in enumerate(keys)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], ["a", "b"])

    return run


def _all_similar(shingle: int, least: float):
    """Which of many pairs of texts are alike; sets are kept until they hold KEPT shingles."""

    def run(left: list, right: list) -> np.ndarray:
        sets: dict[str, np.ndarray] = {}
        held = 0

        def of(text: str) -> np.ndarray:
            nonlocal held
            if text not in sets:
                if held >= KEPT:
                    sets.clear()
                    held = 0
                sets[text] = np.unique(np.array(shingle_hashes(text.encode("utf-8", "replace"), shingle), np.uint64))
                held += len(sets[text])
            return sets[text]

        return np.array([alike(of(a), of(b), least) for a, b in zip(left, right, strict=True)], bool)

    return run


def _similar_components(sketches: DataFrame, texts: DataFrame, shingle: int, least: float, bits: int = BITS) -> DataFrame:
    """(text_key, root) of the texts that have a near copy. sketches: text_key, fp, bands; texts: text_key, text."""
    # texts whose SimHashes the index connects are one more list, however far a chain of links goes
    near_fps = components(links(sketches.select("fp").distinct(), bits)).select(F.col("node").alias("fp"), "root")
    rooted = sketches.select("text_key", "fp").join(near_fps, "fp", "left").select(F.col("text_key").alias("node"), F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("key"))
    keys = sketches.select(F.col("text_key").alias("node"), F.explode("bands").alias("key")).union(rooted).distinct()
    lists = keys.groupBy("key").agg(F.min("node").alias("first"), F.count("*").cast("int").alias("n")).where("n > 1")
    members = materialize(keys.join(lists, "key").withColumn("near", F.col("node") != F.col("first")), "near-members")
    wanted = members.select(F.col("node").alias("text_key")).distinct()
    copies = materialize(texts.join(wanted, "text_key", "left_semi").dropDuplicates(["text_key"]).withColumn("size", F.octet_length("text")), "near-texts")
    left, right = (copies.select(F.col("text_key").alias(k), F.col("text").alias(t)) for k, t in (("a", "left"), ("b", "right")))

    def edges(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(left, "a").join(right, "b")
        bounded(joined)
        return joined.mapInArrow(_similar(shingle, least), "a BIGINT, b BIGINT")

    # that they share a band is all that is known of two members
    said = copies.select(F.col("text_key").alias("node"), "text", "size")
    found = linked(members, edges, said, _all_similar(shingle, least), (), lambda one, other: one["node"] != other["node"], TILE, "near")
    forget(members)
    forget(copies)
    return found.withColumnRenamed("node", "text_key")


def keep_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = STAGE_SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """One row of each group of texts that pairs of at least the shingle similarity connect, that of the smallest id,
    with its own columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    sketches = materialize(arrow_map(texts, lambda: lambda values: text_sketches(values, shingle), "text", _SKETCH, binary=True, size=64), "sketches")
    found = _similar_components(sketches, texts.select("text_key", "text"), shingle, least)
    # the row to stay: of the smallest id, then of the smallest text key
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))
    rooted = sketches.select("doc_id", "text_key").join(found, "text_key", "left")
    stay = rooted.groupBy(F.coalesce("root", "text_key")).agg(F.min(order).alias("o")).select(F.xxhash64("o.doc_id").alias("id_key"), F.col("o.text_key").alias("text_key"))
    # joined and made distinct by the same keys: texts are shuffled once
    rows = packed(docs, id_key=F.xxhash64(id_col), text_key=F.xxhash64(text))
    return unpacked(rows.join(stay, ["text_key", "id_key"], "left_semi").dropDuplicates(["text_key", "id_key"]))
