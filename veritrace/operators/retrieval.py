"""BM25: corpus figures of the terms that are asked for, then each query's best documents, chosen where they are read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X

K1, B = 1.5, 0.75
BLOCK = 256  # queries whose scores of a batch are held at once,
PAIRS = 1 << 20  # and postings that meet them at once


def term_frequencies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf)."""
    return docs.select(F.col(id_col).alias("id"), F.explode(X.bm25_tokens(F.col(text_col))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def document_frequencies(tf: DataFrame, n: int) -> DataFrame:
    """(term, df, idf); n counts all documents, also those without a term."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))


class Asked(NamedTuple):
    """Queries by their terms: their ids, all terms in order, and of each term the positions of the queries that have it."""

    ids: pa.Array
    terms: pa.Array
    counts: np.ndarray
    queries: np.ndarray


def _asked(queries: DataFrame, query_id: str, query_text: str) -> Asked:
    one = queries.select(F.col(query_id).alias("id"), F.explode(X.bm25_tokens(F.col(query_text))).alias("term")).distinct()
    rows = one.groupBy("id").agg(F.collect_list("term").alias("terms")).toArrow().combine_chunks()
    ids, lists = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns)
    coded = pc.dictionary_encode(lists.flatten().cast(pa.string()))
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    terms = place[coded.indices.to_numpy()]
    of = np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    by_term = np.lexsort((of, terms))
    return Asked(ids, coded.dictionary.take(pa.array(order)), np.bincount(terms, minlength=len(order)), of[by_term])


def _frequencies(lists: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, frequency) of the asked terms, by row and term; and how many words each row has."""
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    at = pc.fill_null(pc.index_in(lists.flatten().cast(pa.string()), value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    cells, tf = np.unique((np.repeat(np.arange(len(lists)), lengths) * len(terms) + at)[at >= 0], return_counts=True)
    return cells // max(1, len(terms)), cells % max(1, len(terms)), tf, lengths


def _corpus(docs: DataFrame, terms: pa.Array) -> tuple[int, int, np.ndarray]:
    """Documents, their words, and how many documents have each asked term. A task gives its own sums only."""
    n = len(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n + 2, np.int64)
        for batch in batches:
            _, term, _, lengths = _frequencies(batch.column("terms"), terms)
            sums[:n] += np.bincount(term, minlength=n)
            sums[n:] += len(lengths), lengths.sum()
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["at", "n"])

    rows = docs.select("terms").mapInArrow(run, "at BIGINT, n BIGINT").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(n + 2, np.int64)
    sums[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return int(sums[n]), int(sums[n + 1]), sums[:n]


def _sort_keys(a: pa.Array) -> list[pa.Array]:
    return [k for part in a.flatten() for k in _sort_keys(part)] if pa.types.is_struct(a.type) else [a]


def _in_order(batch: pa.RecordBatch, name: str) -> pa.RecordBatch:
    keys = _sort_keys(batch.column(name))
    names = [str(i) for i in range(len(keys))]
    return batch.take(pc.sort_indices(pa.table(keys, names), sort_keys=[(k, "ascending") for k in names], null_placement="at_start"))


def _best(asked: Asked, idf: np.ndarray, avg_dl: float, top_k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each batch of documents the first top_k of each query; queries are taken BLOCK at a time."""
    block_of, starts = asked.queries // BLOCK, np.cumsum(asked.counts) - asked.counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = _in_order(whole, "doc_ord")
            row, term, tf, lengths = _frequencies(batch.column("terms"), asked.terms)
            weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / max(1.0, avg_dl)))
            for block in range(-(-len(asked.ids) // BLOCK)):
                first, n = block * BLOCK, min(BLOCK, len(asked.ids) - block * BLOCK)
                own = np.concatenate(([0], np.cumsum(block_of == block)))  # queries of the block before each posting
                begin, counts = own[starts], own[starts + asked.counts] - own[starts]
                queries = asked.queries[block_of == block] - first
                scores = np.zeros((n, batch.num_rows))
                pairs, cut = counts[term], 0
                ends = np.cumsum(pairs)
                while cut < len(row):  # some postings at once, whole documents: of equal texts sums are equal
                    to = max(int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + PAIRS)), cut + 1)
                    to = int(np.searchsorted(row, row[to - 1], "right"))
                    c = pairs[cut:to]
                    at = np.repeat(begin[term[cut:to]] - (np.cumsum(c) - c), c) + np.arange(c.sum())
                    low, high = row[cut], row[to - 1] + 1
                    cells = queries[at] * (high - low) + np.repeat(row[cut:to] - low, c)
                    scores[:, low:high] = np.bincount(cells, np.repeat(weight[cut:to], c), n * (high - low)).reshape(n, -1)
                    cut = to
                scores = np.floor(scores * 1e9 + 0.5)
                for _ in range(min(top_k, batch.num_rows)):
                    doc = scores.argmax(axis=1)  # the first of equal ones
                    best = scores[np.arange(n), doc]
                    q = np.flatnonzero(best > 0)
                    scores[np.arange(n), doc] = 0
                    if not len(q):
                        break
                    d = pa.array(doc[q])
                    columns = [asked.ids.take(pa.array(q + first)), batch.column("doc_id").take(d), batch.column("doc_ord").take(d), pa.array(best[q] / 1e9)]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "doc_id", "doc_ord", "score"])

    return run


def bm25(queries: DataFrame, docs: DataFrame, query_id: str, query_text: str, doc_id: str, doc_text: str, top_k: int = 5, min_ratio: float = 0.0, order: str | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the first top_k documents by score, ties by doc order, down to min_ratio of the
    best. Only documents that share a term with a query are scored. A row of docs is a document, and its id unique.

    Documents are read twice and never shuffled: for the corpus figures, of which a task gives a row for each asked term,
    and for scores, of which a batch of documents gives each query's best. The terms of all queries are known to the
    driver and to each task.
    """
    asked = _asked(queries, query_id, query_text)
    cut = docs.select(F.col(doc_id).alias("doc_id"), F.col(order or doc_id).alias("doc_ord"), X.bm25_tokens(F.col(doc_text)).alias("terms"))
    n, words, df = _corpus(cut, asked.terms)
    idf = np.log((n - df + 0.5) / (df + 0.5) + 1)
    kinds = [queries.schema[query_id], cut.schema["doc_id"], cut.schema["doc_ord"]]
    schema = T.StructType([*(T.StructField(name, f.dataType) for name, f in zip(("query_id", "doc_id", "doc_ord"), kinds, strict=True)), T.StructField("score", T.DoubleType())])
    found = cut.mapInArrow(_best(asked, idf, words / max(1, n), top_k), schema)
    w = Window.partitionBy("query_id")
    ranked = found.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "doc_ord"))).where(F.col("rank") <= top_k)
    best = F.max("score").over(w)
    return ranked.withColumn("best", best).where(F.col("score") >= F.col("best") * min_ratio).select("query_id", "doc_id", "score", "rank")


def symbol_bm25(queries: DataFrame, symbols: DataFrame, query_id: str, query_text: str, top_k: int = 5, min_ratio: float = 0.3) -> DataFrame:
    """bm25() over the documented types and methods of an index: query_id, score, rank, file, line, name, owner."""
    docs = symbol_documents(symbols)
    found = bm25(queries, docs, query_id, query_text, "sym_ord", "text", top_k, min_ratio, order="doc_ord")
    return found.withColumnRenamed("doc_id", "sym_ord").join(docs.select("sym_ord", "file", "line", "name", "owner"), "sym_ord")


def symbol_documents(symbols: DataFrame) -> DataFrame:
    """The corpus of documented types and methods: types first, names by first appearance."""
    rows = symbols.where(F.col("family").isin("types", "methods"))
    kind = F.when(F.col("family") == "types", 0).otherwise(1)
    first = F.min("sym_ord").over(Window.partitionBy("family", "name"))
    words = F.concat_ws(" ", "doc", "name", F.when(F.col("family") == "types", F.col("file")).otherwise(F.col("owner")))
    return rows.select("sym_ord", "file", "line", "name", "owner", words.alias("text"), F.struct(kind.alias("k"), first.alias("first"), "sym_ord").alias("doc_ord"))
