"""The symbol index as Parquet: built from a table of code files, kept, and built again only when files have changed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import symbols as Y


def symbols_of(files: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Numbered symbols of code files (file, text): Java files and error codes of them."""
    java = files.where(F.lower("file").endswith(".java"))
    return Y.numbered(Y.java_symbols(java, config))


def build_index(files: DataFrame, path: str, config: EngineConfig = EngineConfig()) -> str:
    """Write the index of files (file, text, mtime, size) below `path`; returns its folder, named by the fingerprint.

    The manifest is written last, so an index that was not finished is none. Symbols are partitioned by family: a lookup
    reads its own.
    """
    mark = Y.tree_fingerprint(files, config=config).first()["fingerprint"]
    at = f"{path.rstrip('/')}/{mark}"
    symbols_of(files, config).write.mode("overwrite").partitionBy("family").parquet(f"{at}/symbols")
    Y.mapper_statements(files.where(F.lower("file").endswith(".xml"))).write.mode("overwrite").parquet(f"{at}/statements")
    files.agg(F.lit(mark).alias("fingerprint"), F.count("*").alias("n_files")).write.mode("overwrite").parquet(f"{at}/manifest")
    return at


def load_index(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    """(symbols, statements) of an index folder."""
    return spark.read.parquet(f"{at}/symbols"), spark.read.parquet(f"{at}/statements")


def cached_index(files: DataFrame, path: str, config: EngineConfig = EngineConfig()) -> tuple[str, bool]:
    """(folder, whether it was there already): the index of files with this fingerprint, built if it is not there. Paths,
    times, sizes and the settings that change an index make the fingerprint."""
    mark = Y.tree_fingerprint(files, config=config).first()["fingerprint"]
    at = f"{path.rstrip('/')}/{mark}"
    try:
        files.sparkSession.read.parquet(f"{at}/manifest")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return build_index(files, path, config), False
    return at, True
