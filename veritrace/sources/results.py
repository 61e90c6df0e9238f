"""What reviewers hand back: items, verdicts and second verdicts, with the rules of which row survives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..operators.ordering import dense_ids, first_per_key, item_id
from .files import read_json_rows


def last_per_item(rows: DataFrame, key: str, required: str) -> DataFrame:
    """Of each item the last row, by file and position, among those whose key and `required` column are not blank."""
    filled = rows.where((X.strip(F.coalesce(key, F.lit(""))) != "") & (X.strip(F.coalesce(required, F.lit(""))) != ""))
    return first_per_key(filled, [key], [F.desc("file"), F.desc("pos")])


def collect_items(rows: DataFrame) -> DataFrame:
    """Items with an assertion, the first of each trimmed assertion, numbered R-001... in the order of file and position."""
    named = rows.withColumn("assertion", X.strip(F.coalesce("assertion", F.lit("")))).where("assertion != ''")
    once = first_per_key(named, ["assertion"], [F.col("file"), F.col("pos")])
    return dense_ids(once, F.col("file"), [F.col("pos")], "item_ord").withColumn("id", item_id(F.col("item_ord")))


def filled_counts(rows: DataFrame) -> DataFrame:
    """One row: how many result files hold at least one row."""
    return rows.agg(F.count_distinct("file").alias("n_filled"))


def counts_per_class(rows: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """One row: of each class how many result files hold at least one row; a file belongs to the class its name begins
    with."""
    name = F.element_at(F.split("file", "/"), -1)
    return rows.agg(*[F.count_distinct(F.when(name.startswith(c), F.col("file"))).alias(f"n_{c.replace('-', '_')}") for c in classes])


def load_items(spark: SparkSession, path: str) -> DataFrame:
    return collect_items(read_json_rows(spark, path, "`group` STRING, kind STRING, assertion STRING, source STRUCT<file:STRING,line:INT>, text STRING, note STRING"))


def load_verdicts(spark: SparkSession, path: str) -> DataFrame:
    return last_per_item(read_json_rows(spark, path, S.VERDICTS), "item_id", "verdict")


def load_rechecks(spark: SparkSession, path: str) -> DataFrame:
    return last_per_item(read_json_rows(spark, path, S.RECHECKS), "item_id", "second_verdict")
