"""Helpers shared by the operators: the shared folder, whole-row passing and streamed Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a Python step holds as Python objects at once.
SLICE = 256

#: Bytes of a batch that the JVM hands to a Python step, unless the session says otherwise.
BATCH_BYTES = 4 << 20

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="veritrace-")
    return _own_folder[app]


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written herein leaves no shuffle files behind: the plan of a write is its own, nothing reads them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veritrace_path = path
    return out


def materialize_parts(parts: Iterable[DataFrame], label: str) -> DataFrame:
    """Write tables of one schema one after another as one, so that the shuffle files of one part are gone before those of
    the next are there."""
    path, out = "", None
    for df in parts:
        spark = df.sparkSession
        path = path or f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        with _shuffles_dropped(spark):
            df.write.option("compression", "zstd").mode("append").parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    out._veritrace_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_veritrace_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def released(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files of plans that nothing refers to any more, which it does when the driver collects
    its garbage. For use after a large table has been written from them."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of an input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo divisor: the fixed split into learned and held-out rows."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


def packed(df: DataFrame, **extra: Column) -> DataFrame:
    """All columns in one struct `row`, so that no name of theirs can clash with an operator's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in extra.items()])


def unpacked(df: DataFrame) -> DataFrame:
    """The columns that packed() put away, without the operator's."""
    kept = df.schema["row"].dataType.names
    return df.select(*[F.col("row").getField(c).alias(c) for c in kept])


def bounded(df: DataFrame) -> None:
    """Have batches for Python steps end by bytes, so that a worker's memory follows the longest text, not row counts."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(str(conf.get(name)).rstrip("bB")) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))


def freed() -> None:
    """Give a finished task's memory back: workers are used again and would keep it beside the next task's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(values: list) -> list:
    """UTF-8 bytes as strings; bytes that are no UTF-8 become U+FFFD."""
    return [None if v is None else v.decode("utf-8", "replace") for v in values]


def _mapped(df: DataFrame, each: Callable, read: str, schema: T.StructType, binary: bool, size: int, explode: bool) -> DataFrame:
    keep = [f for f in df.schema.fields if f.name != read]
    full = T.StructType([*keep, *schema.fields])
    kept, names = [f.name for f in keep], [f.name for f in schema.fields]
    bounded(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in schema.fields]
        work = None
        for whole in batches:
            work = work or each()
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                values = batch.column(batch.schema.get_field_index(read))
                if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
                    values = values.cast(pa.binary()).to_pylist()  # a string need not be UTF-8
                    values = values if binary else texts_of(values)
                else:
                    values = values.to_pylist()
                others = [batch.column(batch.schema.get_field_index(k)) for k in kept]
                if explode:
                    counts, columns = work(values)
                    rows = pa.array(np.repeat(np.arange(batch.num_rows), counts))
                    others = [c.take(rows) for c in others]
                else:
                    columns = list(zip(*work(values), strict=True)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays(others + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], kept + names)
                values = columns = others = batch = None
            whole = None
        work = None
        freed()

    return df.mapInArrow(run, full)


def arrow_map(df: DataFrame, each: Callable[[], Callable[[list], list[tuple]]], read: str, schema: T.StructType, binary: bool = False, size: int = SLICE) -> DataFrame:
    """Every column of df but `read`, and the columns of schema that a function makes from column `read`.

    each() is called once a task and returns a function from a list of values to a list of tuples. `binary` hands
    strings over as UTF-8 bytes. Batches end by bytes and are taken `size` rows at a time, so a worker's memory follows
    the longest value.
    """
    return _mapped(df, each, read, schema, binary, size, False)


def arrow_explode(df: DataFrame, each: Callable[[], Callable[[list], tuple[list[int], list]]], read: str, schema: T.StructType, binary: bool = False, size: int = SLICE) -> DataFrame:
    """As arrow_map, but a value gives any number of rows: the function returns how many each value gave and the
    columns of all of them, as arrays or lists."""
    return _mapped(df, each, read, schema, binary, size, True)
