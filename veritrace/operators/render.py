"""Task packs and reports as rows of text, put together in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas as S

LABELS = {S.BY_SCRIPT: "found by script", S.BY_PENDING: "not reviewed yet", S.BY_AI: "reviewed, quotes verified", S.BY_BOUNCED: "reviewed, quotes do not match"}
VERDICT_RULES = "Answer each item with implemented, partial, missing, deviated or undecidable; quote the code word for word."
SECOND_RULES = "Try to refute each claim; answer confirmed, refuted, partial or unverifiable, with evidence for every clause."
ITEM_RULES = "List every rule that these blocks state: group, kind (existence or behavior), assertion, source."


def label(checked_by: Column) -> Column:
    out = F.concat(F.lit("second review: "), F.regexp_replace(checked_by, "^.*:", ""))
    for value, text in LABELS.items():
        out = F.when(checked_by == value, text).otherwise(out)
    return out


def ordered_text(rows: DataFrame, key: str, order: Column, text: Column, name: str, sep: str = "\n") -> DataFrame:
    """(key, name): the texts of each key in order."""
    part = rows.select(key, order.alias("o"), text.alias("t"))
    return part.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), sep).alias(name))


def numbered_sections(rows: DataFrame, key: str, order: str, text: Column) -> DataFrame:
    """(key, body): numbered lines of each key; keys without rows have no section."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return ordered_text(rows.withColumn("n", n).withColumn("line", F.concat(F.col("n").cast("string"), F.lit(". "), text)), key, F.col("n"), F.col("line"), "body")


def counts(placed: DataFrame) -> DataFrame:
    """By placement, what a report's limits section states."""
    return placed.groupBy("placement").agg(
        F.count("*").alias("n_items"),
        F.count_if(F.col("checked_by") == S.BY_PENDING).alias("n_pending"),
        F.count_if(F.col("checked_by") == S.BY_BOUNCED).alias("n_bounced"),
        F.count_if(F.col("verdict") == "undecidable").alias("n_undecidable"),
    )


def sample(rows: DataFrame, size: int, seed: int = 0, key: str = "item_id") -> DataFrame:
    """`size` rows, each as likely as any other: the same for a seed, however the rows are dealt to tasks."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(size)


def first_position(evidence: Column) -> Column:
    """`file:line` of the first evidence that names a file, else empty."""
    named = F.filter(evidence, lambda e: F.coalesce(e["file"], F.lit("")) != "")
    return F.coalesce(F.get(F.transform(named, lambda e: F.concat_ws(":", e["file"], e["line"].cast("string"))), F.lit(0)), F.lit(""))


def first_quote(evidence: Column) -> Column:
    quoted = F.filter(evidence, lambda e: F.coalesce(e["quote"], F.lit("")) != "")
    return F.coalesce(F.get(F.transform(quoted, lambda e: e["quote"]), F.lit(0)), F.lit(""))


def first_nearest(nearest: Column) -> Column:
    return F.coalesce(F.get(F.transform(nearest, lambda n: F.concat_ws(" ", n["name"], F.concat_ws(":", n["file"], n["line"].cast("string")))), F.lit(0)), F.lit(""))


SNIPPET_LINES = 4


def with_snippets(records: DataFrame, files: DataFrame) -> DataFrame:
    """records with snippet and earlier_snippet: what their evidence quotes, else SNIPPET_LINES lines of the file from the
    evidence's line on, or from the line before; empty where there is neither. files: file, text."""
    quote = first_quote(F.col("evidence"))
    named = F.get(F.filter("evidence", lambda e: F.coalesce(e["file"], F.lit("")) != ""), F.lit(0))
    at = records.withColumn("_quote", quote).withColumn("_file", named["file"]).withColumn("_line", named["line"].cast("string"))
    line = F.coalesce(F.expr("try_cast(_line AS INT)"), F.lit(1))
    rows = at.join(files.select(F.col("file").alias("_file"), F.col("text").alias("_text")), "_file", "left")
    part = lambda start: F.coalesce(F.array_join(F.slice(F.split("_text", "\n"), F.greatest(start, F.lit(1)), SNIPPET_LINES), "\n"), F.lit(""))
    said = lambda start: F.when(F.col("_quote") != "", F.col("_quote")).otherwise(part(start))
    return rows.withColumn("snippet", said(line)).withColumn("earlier_snippet", said(line - 1)).drop("_quote", "_file", "_line", "_text")


def record_text(snippet: Column) -> Column:
    """One record of a report: rows have item_id, assertion, verdict, checked_by, reason, evidence, nearest. What is
    missing shows what the code has that is like it; what was done otherwise or is open shows where and what."""
    shown = F.when(snippet != "", F.concat(F.lit("\n\n> "), F.regexp_replace(snippet, "\n", "\n> "))).otherwise("")
    position, like = first_position(F.col("evidence")), first_nearest(F.col("nearest"))
    at = F.when(position != "", F.concat(F.lit("\n- where: "), position)).otherwise("")
    closest = F.when((F.col("verdict") == "missing") & (like != ""), F.concat(F.lit("\n- closest: "), like)).otherwise("")
    reason = F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit("\n- reason: "), "reason")).otherwise("")
    return F.concat(F.lit("### "), F.col("item_id"), F.lit(" "), F.col("assertion"), F.lit("\n\n- verdict: "), F.col("verdict"), F.lit("\n- checked: "), label(F.col("checked_by")), reason, at, closest, shown)


def extra_text() -> Column:
    """One endpoint that nobody asked for."""
    return F.concat(F.lit("### "), "http", F.lit(" "), "path", F.lit("\n\n- where: "), F.concat_ws(":", "file", F.col("line").cast("string")), F.lit("\n- handler: "), F.concat_ws(".", "owner", "handler"))


def reports(records: DataFrame, extras: DataFrame, files: DataFrame, sample_size: int = 20, seed: int = 0) -> DataFrame:
    """(report, ord, text) of the reports `fix` and `confirm`, to be written in order; sections are numbered as they
    come, and only those with rows appear.

    records: item_id, item_ord, assertion, verdict, checked_by, reason, placement, evidence, nearest.
    """
    rows = with_snippets(records, files)
    fix = rows.where(F.col("placement") == S.PLACE_FIX).withColumn("section", F.when(F.col("verdict") == "missing", "1 Not done").otherwise("2 Done otherwise"))
    confirm = rows.where(F.col("placement") == S.PLACE_CONFIRM).withColumn("section", F.lit("1 To be confirmed"))
    shown = sample(rows.where((F.col("placement") == S.PLACE_OK) & (F.size("evidence") > 0)), sample_size, seed).withColumn("section", F.lit("3 Sample of what was found in order"))
    text = lambda part, name, body, o: part.select(F.lit(name).alias("report"), "section", o.alias("o"), body.alias("text"))
    number = F.lpad(F.col("item_ord").cast("string"), 20, "0")
    out = text(fix, "fix", record_text(F.col("snippet")), number).union(text(shown, "fix", record_text(F.col("earlier_snippet")), number)).union(text(confirm, "confirm", record_text(F.col("snippet")), number))
    out = out.union(text(extras.withColumn("section", F.lit("2 In code, not asked for")), "confirm", extra_text(), F.col("path")))
    limit = F.concat(F.lit("- "), "placement", F.lit(": "), F.col("n_items").cast("string"), F.lit(" items, not reviewed "), F.col("n_pending").cast("string"), F.lit(", quotes failed "), F.col("n_bounced").cast("string"), F.lit(", undecidable "), F.col("n_undecidable").cast("string"))
    out = out.union(text(counts(records).withColumn("section", F.lit("4 Limits")), "fix", limit, F.col("placement")))
    # only sections, not their rows, meet where headings are numbered
    sections = out.select("report", "section").distinct().withColumn("n", F.row_number().over(Window.partitionBy("report").orderBy("section")))
    heads = sections.select("report", "section", F.lit("").alias("o"), F.concat(F.lit("## "), F.col("n").cast("string"), F.lit(". "), F.regexp_replace("section", r"^\d+ ", "")).alias("text"))
    both = out.withColumn("head", F.lit(1)).union(heads.withColumn("head", F.lit(0)))
    return both.select("report", F.struct("section", "head", "o").alias("ord"), "text")
