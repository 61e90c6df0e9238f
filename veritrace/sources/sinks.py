"""Where results go: tables, single documents, blanks for reviewers, stage notes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Parquet; symbols are partitioned by family, so that a lookup reads only its own."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_document(lines: DataFrame, path: str, order: list[str], column: str = "text") -> None:
    """One text file of rows in order."""
    lines.orderBy(*order).select(column).coalesce(1).write.mode("overwrite").text(path)


def write_blanks(batches: DataFrame, path: str, key: str = "batch") -> DataFrame:
    """Appends blanks for batches that have none yet: what a reviewer has filled in is never overwritten. Returns those."""
    spark = batches.sparkSession
    try:
        have = spark.read.parquet(path).select(key)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        new = batches
    else:
        new = batches.join(have, key, "left_anti")
    new.write.mode("append").parquet(path)
    return new


def note_stage(spark: SparkSession, work: str, stage: str, step: str, status: str, detail: str = "") -> None:
    """Appends one line to a stage's progress table."""
    row = spark.range(1).select(F.lit(stage).alias("stage"), F.lit(step).alias("step"), F.lit(status).alias("status"), F.lit(detail).alias("detail"), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("at"))
    row.write.mode("append").parquet(f"{work}/progress")


def status(spark: SparkSession, work: str) -> DataFrame:
    """The last step of each stage."""
    rows = spark.read.parquet(f"{work}/progress")
    return rows.groupBy("stage").agg(F.max_by(F.struct("step", "status", "detail", "at"), "at").alias("s")).select("stage", "s.*")
