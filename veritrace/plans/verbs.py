"""The four verbs as plans: extract, compare, verify, report. Each takes tables and gives tables; what people or models
fill in between them comes back as tables, too (sources.results)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..config import EngineConfig
from ..functions import text as X
from ..operators import blocks as B
from ..operators import context, coverage, lookup, packs, render, retrieval, verdict


@dataclass(frozen=True)
class Extraction:
    blocks: DataFrame
    packs: DataFrame


@dataclass(frozen=True)
class Comparison:
    static: DataFrame
    checked: DataFrame
    evidence: DataFrame
    log: DataFrame
    batches: DataFrame
    snippets: DataFrame
    packs: DataFrame
    blanks: DataFrame


@dataclass(frozen=True)
class Verification:
    merged: DataFrame
    claims: DataFrame
    packs: DataFrame
    windows: DataFrame
    blanks: DataFrame


@dataclass(frozen=True)
class Report:
    records: DataFrame
    extras: DataFrame
    lines: DataFrame


def as_planned(table: DataFrame, name: str) -> DataFrame:
    """Leaves a table that is read several times to the plan."""
    return table


def kept_below(path: str) -> Callable[[DataFrame, str], DataFrame]:
    """Writes each table that is read several times below `path`: it is computed once, and plans stay small."""

    def keep(table: DataFrame, name: str) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{path}/{name}")
        return table.sparkSession.read.schema(table.schema).parquet(f"{path}/{name}")

    return keep


def said_by(items: DataFrame) -> DataFrame:
    """items with what they say, ids: the identifiers in it, and text and note where they are null."""
    rows = items.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("note", F.coalesce("note", F.lit("")))
    return rows.withColumn("ids", X.identifiers(F.concat_ws("\n", "assertion", "text")))


def extract(documents: DataFrame, config: EngineConfig = EngineConfig()) -> Extraction:
    """Requirement documents (file, text) as numbered blocks and the packs that items are drawn from."""
    found = B.numbered_blocks(B.split_blocks(documents, most=config.max_block_lines))
    return Extraction(found, packs.extraction_packs(found, config))


def recalled(batched: DataFrame, anchors: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(batch, snippet_ord, file, start, end, code): code for each batch, of the files its anchors name first, then of
    those that read most like its items. anchors: batch, file, line, anchor_ord."""
    own = context.anchor_files(anchors, "batch", "file", "line", "anchor_ord")
    asked = render.ordered_text(batched, "batch", F.col("item_ord"), F.concat_ws("\n", "assertion", "text"), "asked")
    ranked = retrieval.symbol_bm25(asked, symbols, "batch", "asked").select(F.col("query_id").alias("batch"), "file", "line", "rank")
    once = ranked.groupBy("batch", "file").agg(F.min("rank").alias("rank"), F.min_by("line", "rank").alias("line"))
    more = context.top_up(own, once, "batch", "file")
    both = own.select("batch", "file", "line", "file_rank").unionByName(more.select("batch", "file", "line", "file_rank"))
    shown = context.snippets(both, files.select("file", "text")).where("code != ''")
    start = F.greatest(F.lit(1), F.col("line") - context.BEFORE)
    return shown.select("batch", F.col("file_rank").alias("snippet_ord"), "file", start.cast("int").alias("start"), (start + F.size(F.split("code", "\n")) - 1).cast("int").alias("end"), "code")


def compare(items: DataFrame, symbols: DataFrame, files: DataFrame, scope: list[str], config: EngineConfig = EngineConfig(), kept: Callable[[DataFrame, str], DataFrame] = as_planned) -> Comparison:
    """What code says of each item by itself, and packs for what a reviewer must judge. items: ITEMS with item_id;
    symbols: numbered; files: file, text. kept: what becomes of tables that are read several times."""
    said = said_by(items)
    every = lookup.checks(said)
    run = kept(lookup.run_checks(every, symbols), "hits")
    checked = kept(lookup.nearest_on_miss(run, symbols), "checked")
    static = kept(lookup.static_verdicts(said, run), "static")
    n_files = files.agg(F.count("*").alias("n_files"))
    log = lookup.search_log(said.join(F.broadcast(n_files)), scope, F.col("n_files"))
    batched = kept(packs.verdict_batches(said, static, config), "batches")
    sites = lookup.hit_sites(every, symbols).join(batched.select("item_id", "item_ord", "batch"), "item_id")
    order = F.struct("item_ord", "check_ord", F.lit(0).alias("step"), "sym_ord")
    anchors = sites.select("batch", "file", "line", order.alias("anchor_ord"))
    followed = context.follow_handlers(sites.where("family = 'urls'"), symbols.where("family = 'methods'"))
    further = F.struct("item_ord", "check_ord", F.lit(1).alias("step"), F.col("m_ord").alias("sym_ord"))
    anchors = anchors.union(followed.select("batch", "m_file", "m_line", further))
    snippets = recalled(batched, anchors, symbols, files)
    return Comparison(static, checked, lookup.flatten_hits(checked), log, batched, snippets, packs.verdict_packs(batched, snippets, config), packs.blank_verdicts(batched))


def merge(items: DataFrame, comparison: Comparison, verdicts: DataFrame, files: DataFrame) -> DataFrame:
    """items with verdict, checked_by, evidence, nearest and reason: of the static check or of a reviewer whose quotes
    stand in the code. verdicts: VERDICTS, a row an item; files: file, text."""
    checked = verdict.problems_of(verdict.verify_evidence(verdicts, files, ["item_id"]), ["item_id"])
    external = verdicts.select("item_id", F.col("verdict").alias("x_verdict"), F.col("evidence").alias("x_evidence"), F.col("reason").alias("x_reason")).join(checked, "item_id")
    # a verdict of `missing` needs no evidence
    static = comparison.static.select("item_id", "route", F.col("verdict").alias("s_verdict"), F.col("reason").alias("s_reason"))
    rows = verdict.merge_verdicts(items, static, external)
    found = F.transform("evidence", lambda e: F.struct(e["file"].alias("file"), e["line"].cast("string").alias("line"), F.lit(None).cast("string").alias("quote")))
    hits = comparison.evidence.select("item_id", found.alias("s_evidence"))
    near = comparison.checked.where(F.size("nearest") > 0).groupBy("item_id").agg(F.min_by("nearest", "check_ord").alias("nearest"))
    script = F.col("route") == S.ROUTE_STATIC
    none = F.array().cast(S.EVIDENCE)
    rows = rows.join(hits, "item_id", "left").join(near, "item_id", "left")
    rows = rows.withColumn("evidence", F.coalesce(F.when(script, F.col("s_evidence")).otherwise(F.col("x_evidence")), none))
    rows = rows.withColumn("reason", F.coalesce(F.when(script, F.col("s_reason")).otherwise(F.col("x_reason")), F.lit("")))
    rows = rows.withColumn("nearest", F.coalesce("nearest", F.array().cast("array<struct<name:string,file:string,line:int>>")))
    return rows.withColumn("has_evidence", F.size("evidence") > 0).drop("s_evidence", "x_evidence", "s_reason", "x_reason")


def verify(items: DataFrame, merged: DataFrame, symbols: DataFrame, files: DataFrame, config: EngineConfig = EngineConfig(), kept: Callable[[DataFrame, str], DataFrame] = as_planned) -> Verification:
    """Claims that a second review is worth, with the code they may be quoted from. kept: as in compare()."""
    claims = verdict.enrich_claims(verdict.select_claims(merged).drop("text", "note"), items)
    batched = kept(packs.recheck_batches(claims, config), "claims")
    own = kept(packs.method_windows(batched, symbols.where("family = 'methods'"), files, config), "own-windows")
    first = batched.select("batch", "item_ord", F.posexplode("evidence").alias("ev_ord", "e"))
    order = F.struct("item_ord", F.col("ev_ord").alias("check_ord"), F.lit(0).alias("step"), F.lit(0).cast("bigint").alias("sym_ord"))
    anchors = first.select("batch", F.col("e.file").alias("file"), F.expr("try_cast(e.line AS INT)").alias("line"), order.alias("anchor_ord")).where("file IS NOT NULL AND line IS NOT NULL")
    found = kept(recalled(batched, anchors, symbols, files), "recalled")
    shown = batched.select("batch", "item_id").join(own, "item_id").select("batch", "file", "start", "end")
    shared = found.join(shown, ["batch", "file", "start", "end"], "left_anti").dropDuplicates(["batch", "file", "start", "end"])
    texts, windows = packs.recheck_packs(batched, own, shared, config)
    return Verification(merged, batched, texts, windows, packs.blank_seconds(batched))


def unasked(items: DataFrame, symbols: DataFrame) -> DataFrame:
    """Endpoints that no item mentions, by its words, its text's or its source's name."""
    said = items.select(F.concat_ws("\n", "assertion", "text", "source.file").alias("said"))
    urls = symbols.where("family = 'urls'").select(X.key_path(F.col("name")).alias("path"), F.col("sym_ord").alias("url_ord"), X.key_verb(F.col("name")).alias("http"), "file", "line", "handler", "owner")
    return coverage.extra_paths(urls, coverage.mention_words(said, "said"), coverage.mention_paths(said, "said"))


def report(items: DataFrame, merged: DataFrame, rechecks: DataFrame, windows: DataFrame, symbols: DataFrame, files: DataFrame, config: EngineConfig = EngineConfig()) -> Report:
    """Records with their placement, endpoints nobody asked for, and both reports' lines. rechecks: RECHECKS, a row an
    item; windows: WINDOWS."""
    seconds = verdict.effective_seconds(rechecks, files, windows)
    decided = verdict.apply_rechecks(merged, seconds)
    records = decided.withColumn("placement", verdict.placement(F.col("verdict"), F.col("checked_by"), F.col("has_evidence"), F.col("forced_placement"), config))
    extras = unasked(items, symbols)
    return Report(records, extras, render.reports(records, extras, files, config.sample_size, config.seed))
