"""Order-dependent steps without one task for all rows: dense numbers, running budgets, chunks, firsts and lasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .. import schemas as S


def dense_ids(df: DataFrame, bucket: Column, order: list[Column], name: str) -> DataFrame:
    """df with a global number from 1 in the order of (bucket, order).

    Rows are numbered within their bucket, each bucket is moved on by the rows of the buckets before: only the buckets'
    counts meet in one task, so buckets should be many times fewer than rows (files, ranges of ids).
    """
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_bucket").alias("_own"), (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    numbered = keyed.withColumn("_within", within).join(before, F.col("_bucket").eqNullSafe(F.col("_own")))
    return numbered.withColumn(name, F.col("_before") + F.col("_within")).drop("_bucket", "_own", "_before", "_within")


def block_id(number: Column) -> Column:
    return F.format_string("B%04d", number)


def item_id(number: Column) -> Column:
    return F.format_string("R-%03d", number)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; with descending order the last."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def within_budget(df: DataFrame, keys: list[str], order: list[Column], cost: Column, budget: int, keep_first: bool = False, base: Column | None = None) -> DataFrame:
    """The leading rows of each key whose running cost, with what `base` charges before, stays in the budget; costs must
    not be negative, so stopping at the first overflow is a filter. keep_first: the first row stays however large."""
    w = Window.partitionBy(*keys).orderBy(*order)
    total = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)) + (base if base is not None else F.lit(0))
    fits = total <= budget
    if keep_first:
        fits = fits | (F.row_number().over(w) == 1)
    return df.withColumn("_fits", fits).where("_fits").drop("_fits")


def chunked(df: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """batch: a number from 1 over all chunks of `size` rows of each group, groups by first appearance.

    Only one row a chunk goes through the numbering.
    """
    w = Window.partitionBy(group)
    rows = df.withColumn("_first", F.min(order).over(w)).withColumn("_chunk", F.floor((F.row_number().over(w.orderBy(order)) - 1) / size))
    chunks = dense_ids(rows.select("_first", "_chunk").distinct(), F.col("_first"), [F.col("_chunk")], "batch")
    return rows.join(chunks, ["_first", "_chunk"]).drop("_first", "_chunk")


def greedy_batches(df: DataFrame, keys: list[str], order: str, cost: Column, section: Column, max_cost: int, max_rows: int, break_share: float = 0.6) -> DataFrame:
    """batch: the number, from 0 in each key, of a greedy packing in order.

    A row opens a new batch if it would pass the cost or the number of rows, or if its section differs from the last
    row's and the batch is over `break_share` of the cost. The state starts anew with each batch, so it is a fold over a
    key's rows (order, cost, section), which are all that is gathered.
    """
    slim = df.select(*keys, F.struct(F.col(order).cast("long").alias("o"), cost.cast("long").alias("c"), F.coalesce(section, F.lit("")).alias("s")).alias("x"))

    def fold(rows: list[dict]) -> list[int]:
        out, batch, total, n, last = [], -1, 0, 0, ""
        for x in rows:
            if n == 0 or total + x["c"] > max_cost or n >= max_rows or (x["s"] != last and total > max_cost * break_share):
                batch, total, n = batch + 1, 0, 0
            total, n, last = total + x["c"], n + 1, x["s"]
            out.append(batch)
        return out

    folded = folded_groups(slim, keys, fold, "INT").select(*keys, F.col("x.o").alias(order), F.col("y").alias("batch"))
    return df.join(folded, [*keys, order])


def folded_groups(rows: DataFrame, keys: list[str], fold: Callable[[list[dict]], list], kind: str) -> DataFrame:
    """(keys, x, y): each key's structs `x` in order with what fold() makes of them, a value of SQL type `kind` each.

    Groups are gathered by the JVM and folded many to a batch; a key's structs must fit a task's memory.
    """
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    schema = T.StructType([*lists.schema.fields, T.StructField("ys", T.ArrayType(S.schema(f"y {kind}")["y"].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for batch in batches:
            made = pa.array([fold(xs) for xs in batch.column("xs").to_pylist()], out.field("ys").type)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], schema=pa.schema([*batch.schema, out.field("ys")]))

    return lists.mapInArrow(run, schema).select(*keys, F.explode(F.arrays_zip("xs", "ys")).alias("z")).select(*keys, F.col("z.xs").alias("x"), F.col("z.ys").alias("y"))
