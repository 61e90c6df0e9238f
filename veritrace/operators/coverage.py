"""Reverse coverage: endpoints that no requirement mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X


def mention_words(items: DataFrame, text: str = "text") -> DataFrame:
    """(word): words of four characters and more, lower case, with all types, methods and fields."""
    ids = X.identifiers(F.col(text))
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z][A-Za-z0-9_]{3,})"), F.lit(1))
    return items.select(F.explode(F.array_distinct(F.transform(F.concat(words, ids["types"], ids["methods"], ids["fields"]), F.lower))).alias("word")).distinct()


def mention_paths(items: DataFrame, text: str = "text") -> DataFrame:
    """(path): normalised paths in requirement texts."""
    return items.select(F.explode(X.paths(F.col(text))).alias("p")).select(X.norm_url(F.col("p")).alias("path")).distinct()


def segment_frequency(paths: DataFrame, path: str = "path") -> DataFrame:
    """(segment, freq): in how many distinct raw paths a segment stands."""
    own = paths.select(path).distinct().select(F.explode(F.array_distinct(F.transform(X.segments(F.col(path)), F.lower))).alias("segment"))
    return own.groupBy("segment").agg(F.count("*").alias("freq"))


def mentioned_modules(paths: DataFrame, path: str = "path") -> DataFrame:
    """(module): first segments of mentioned paths."""
    return paths.select(F.lower(F.try_element_at(X.segments(F.col(path)), F.lit(1))).alias("module")).where(F.col("module").isNotNull()).distinct()


def guess_group(path, segments):
    """The first segment that says something, else the path."""
    return F.coalesce(F.try_element_at(F.filter(segments, lambda s: ~F.lower(s).isin(*S.TOO_COMMON)), F.lit(1)), path)


def extra_paths(urls: DataFrame, words: DataFrame, paths: DataFrame, min_segments: int = 2) -> DataFrame:
    """(path, group, ...) of endpoints nobody asked for. urls: path, url_ord, http, file, line, handler, owner, rows of
    one path in order; words: (word); paths: (path), normalised.

    Every test is an equi-join: segments are rows here, joined to their frequency and to the words.
    """
    first = F.min_by(F.struct("http", "file", "line", "handler", "owner"), "url_ord")
    per_path = urls.groupBy("path").agg(first.alias("f"), F.collect_set(F.lower("handler")).alias("handlers"))
    per_path = per_path.withColumn("segs", X.segments(F.col("path"))).where(F.size("segs") >= min_segments)
    unsaid = per_path.join(paths.select(F.col("path").alias("_norm")), X.norm_url(F.col("path")) == F.col("_norm"), "left_anti")
    said = words.withColumn("_said", F.lit(True))
    parts = unsaid.select("path", F.explode(F.transform("segs", F.lower)).alias("segment"))
    known = parts.join(segment_frequency(urls), "segment", "left").join(said.withColumnRenamed("word", "segment"), "segment", "left")
    meaningful = ~F.col("segment").isin(*S.TOO_COMMON) & (F.coalesce("freq", F.lit(0)) <= 2)
    judged = known.groupBy("path").agg(F.coalesce(F.bool_and(F.when(meaningful, F.coalesce("_said", F.lit(False)))), F.lit(True)).alias("covered"))
    module = F.lower(F.try_element_at(F.filter("segs", lambda s: ~F.lower(s).isin(*S.TOO_COMMON)), F.lit(1)))
    action = F.lower(F.element_at("segs", -1))
    rest = unsaid.join(judged, "path").where(~F.col("covered")).withColumn("module", module)
    usual = rest.where(action.isin(*S.GENERIC_ACTIONS)).join(mentioned_modules(paths), "module", "left_semi").select("path")
    handled = rest.select("path", F.explode("handlers").alias("word")).join(words, "word", "left_semi").select("path").distinct()
    left = rest.join(usual, "path", "left_anti").join(handled, "path", "left_anti")
    return left.select("path", "f.http", "f.file", "f.line", "f.handler", "f.owner", guess_group(F.col("path"), F.col("segs")).alias("group"))
