"""What reviewers are given: blocks routed to packs, background for them, verdict packs and second-review packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas as S
from ..config import EngineConfig
from ..functions import text as X
from . import ordering, render

BLOCK_LINES, BASE_LINES = 14, 3  # lines that a block costs besides its own


def routed(blocks: DataFrame) -> DataFrame:
    """blocks with route: `image` where there is an image, a heading's too; `text` for the rest but headings."""
    image = F.size("images") > 0
    rows = blocks.withColumn("route", F.when(image, "image").when(F.col("kind") != "heading", "text"))
    return rows.where("route IS NOT NULL")


def line_cost(text: Column, more: int) -> Column:
    return F.size(F.split(text, "\n")) - 1 + more


def base_context(blocks: DataFrame, order: str = "block_ord", config: EngineConfig = EngineConfig()) -> DataFrame:
    """The first blocks that explain terms, data and rules, as many as their lines allow.

    Each costs BASE_LINES at least, so more than budget / BASE_LINES of them can't fit: the running sum is over so few.
    """
    said = F.concat_ws(" ", "heading")
    hinted = F.exists(F.array(*map(F.lit, S.BASE_SECTION_HINTS)), lambda h: said.contains(h))
    rows = blocks.where((F.size("images") == 0) & (F.col("kind") != "heading") & hinted).orderBy(order).limit(config.base_lines // BASE_LINES + 1)
    return ordering.within_budget(rows, [], [F.col(order)], line_cost(F.col("text"), BASE_LINES), config.base_lines)


def block_batches(blocks: DataFrame, key: str = "file", config: EngineConfig = EngineConfig()) -> DataFrame:
    """Routed blocks with pack: their pack's name. Blocks of one document and route are packed greedily in order, so that
    documents are packed in parallel; packs are numbered over all of them."""
    section = F.concat_ws("/", F.slice("heading", 1, F.greatest(F.size("heading") - 1, F.lit(0))))
    cost, rows = line_cost(F.col("text"), BLOCK_LINES), routed(blocks)
    text = ordering.greedy_batches(rows.where("route = 'text'"), [key], "block_ord", cost, section, config.text_batch_lines, config.text_batch_blocks)
    image = ordering.greedy_batches(rows.where("route = 'image'"), [key], "block_ord", cost, section, 10**6, config.image_batch_blocks)
    both = text.unionByName(image)
    first = both.groupBy("route", key, "batch").agg(F.min("block_ord").alias("first"))
    numbered = None
    for route in ("text", "image"):
        part = ordering.dense_ids(first.where(F.col("route") == route), F.col(key), [F.col("first")], "n")
        numbered = part if numbered is None else numbered.unionByName(part)
    return both.join(numbered.select("route", key, "batch", F.format_string("%s-%03d", "route", "n").alias("pack")), ["route", key, "batch"])


def block_text(with_path: bool = True) -> Column:
    """One block as a pack shows it: where it stands, under which headings, and what it says."""
    at = F.concat(F.lit("["), "id", F.lit("] "), "file", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    path = F.when(F.size("heading") > 0, F.concat(F.lit(" ("), F.concat_ws(" / ", "heading"), F.lit(")"))).otherwise("")
    images = F.when(F.size("images") > 0, F.concat(F.lit("\nimages: "), F.concat_ws(", ", "images"))).otherwise("")
    return F.concat(at, path if with_path else F.lit(""), F.lit("\n"), "text", images)


def extraction_packs(blocks: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(pack, text): rules, background and blocks of each pack. blocks: numbered."""
    base = base_context(blocks, config=config).groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("block_ord").alias("o"), block_text().alias("t")))).alias("base"))
    body = render.ordered_text(block_batches(blocks, config=config), "pack", F.col("block_ord"), block_text(), "body", "\n\n")
    background = F.when(F.size("base") > 0, F.concat(F.lit("## Background\n\n"), F.array_join(F.transform("base", lambda x: x["t"]), "\n\n"), F.lit("\n\n"))).otherwise("")
    text = F.concat(F.lit("# "), "pack", F.lit(f"\n\n{render.ITEM_RULES}\n\n"), background, F.lit("## Blocks\n\n"), "body")
    return body.join(F.broadcast(base)).select("pack", text.alias("text"))


def block_listing(blocks: DataFrame, limit: int = 0, width: int = 60) -> DataFrame:
    """(block_ord, row): the blocks as rows of a Markdown table, the first `limit` if there is one."""
    cell = lambda c: F.replace(F.regexp_replace(c, r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))
    rows = blocks.orderBy("block_ord").limit(limit) if limit else blocks
    cells = [F.col("id"), F.col("file"), F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")), cell(F.concat_ws(" / ", "heading")), F.col("kind"), X.clip(cell(F.col("text")), width)]
    return rows.select("block_ord", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("row"))


def verdict_batches(items: DataFrame, static: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Items that a reviewer must judge, with batch: chunks of their groups. items: item_id, item_ord, group."""
    open_ = items.join(static.where(F.col("route") == S.ROUTE_AI).select("item_id"), "item_id", "left_semi")
    group = F.when(F.trim(F.coalesce("group", F.lit(""))) == "", "ungrouped").otherwise(F.col("group"))
    return ordering.chunked(open_.withColumn("_group", group), "_group", "item_ord", config.verdict_batch).drop("_group")


def verdict_packs(batched: DataFrame, snippets: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(batch, name, text): rules, items and code of each batch. batched: batch, item_id, item_ord, assertion, text;
    snippets: batch, snippet_ord, file, code, cut to the lines that a pack may hold, its first one kept."""
    lines = F.size(F.split("code", "\n"))
    kept = ordering.within_budget(snippets, ["batch"], [F.col("snippet_ord")], lines, config.verdict_code_lines, keep_first=True)
    asked = render.ordered_text(batched, "batch", F.col("item_ord"), F.concat(F.lit("- "), "item_id", F.lit(": "), "assertion", F.when(F.col("text") != "", F.concat(F.lit("\n  > "), F.regexp_replace("text", "\n", "\n  > "))).otherwise("")), "asked")
    code = render.ordered_text(kept, "batch", F.col("snippet_ord"), F.concat(F.lit("### "), "file", F.lit("\n"), "code"), "code", "\n\n")
    name = F.format_string("batch-%03d", "batch")
    shown = F.when(F.col("code").isNotNull(), F.concat(F.lit("\n\n## Code\n\n"), "code")).otherwise("\n\nNo code was found for these items.")
    return asked.join(code, "batch", "left").select("batch", name.alias("name"), F.concat(F.lit("# "), name, F.lit(f"\n\n{render.VERDICT_RULES}\n\n## Items\n\n"), "asked", shown).alias("text"))


def blank_verdicts(batched: DataFrame) -> DataFrame:
    """(batch, name, json): what a reviewer of each batch fills in, in the shape that verdicts are read in."""
    one = F.struct("item_id", F.lit("").alias("verdict"), F.array(F.struct(F.lit("").alias("file"), F.lit(0).alias("line"), F.lit("").alias("quote"))).alias("evidence"), F.lit("").alias("reason"), F.array().cast("array<string>").alias("missing"))
    return _blanks(batched, one, "batch-%03d")


def blank_seconds(batched: DataFrame) -> DataFrame:
    """(batch, name, json): the same of a second review."""
    one = F.struct("item_id", F.lit("").alias("second_verdict"), F.array().cast(f"array<struct<text:string,evidence:{S.EVIDENCE}>>").alias("clauses"), F.array().cast(S.EVIDENCE).alias("evidence"), F.lit("").alias("reason"))
    return _blanks(batched, one, "recheck-%03d")


def _blanks(batched: DataFrame, one: Column, name: str) -> DataFrame:
    lists = batched.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("item_ord", one.alias("x")))).alias("xs"))
    return lists.select("batch", F.format_string(name, "batch").alias("name"), F.to_json(F.transform("xs", lambda x: x["x"])).alias("json"))


def recheck_batches(claims: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Claims with batch: chunks of their groups."""
    group = F.when(F.trim(F.coalesce("group", F.lit(""))) == "", "ungrouped").otherwise(F.col("group"))
    return ordering.chunked(claims.withColumn("_group", group), "_group", "item_ord", config.recheck_batch).drop("_group")


def recheck_packs(batched: DataFrame, windows: DataFrame, shared: DataFrame, config: EngineConfig = EngineConfig()) -> tuple[DataFrame, DataFrame]:
    """((batch, name, text), windows shown). batched: batch, item_id, item_ord, assertion, verdict; windows: item_id, file,
    start, end, code; shared: batch, snippet_ord, file, start, end, code.

    The lines of the claims' own windows are charged first; of what is shared as much follows as fits, the first in any
    case. A claim was shown its own window and what its batch shares: that is where a second review may quote from.
    """
    own = batched.select("batch", "item_id", "item_ord", "assertion", "verdict").join(windows, "item_id", "left")
    charged = own.groupBy("batch").agg(F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).alias("_base"))
    rows = shared.join(charged, "batch")
    kept = ordering.within_budget(rows, ["batch"], [F.col("snippet_ord")], F.size(F.split("code", "\n")), config.recheck_code_lines, keep_first=True, base=F.col("_base")).drop("_base")
    claim = F.concat(F.lit("### "), "item_id", F.lit(" "), "assertion", F.lit("\n\nclaimed: "), "verdict", F.when(F.col("code").isNotNull(), F.concat(F.lit("\n\n"), "file", F.lit("\n"), "code")).otherwise(""))
    claims = render.ordered_text(own, "batch", F.col("item_ord"), claim, "claims", "\n\n")
    more = render.ordered_text(kept, "batch", F.col("snippet_ord"), F.concat(F.lit("### "), "file", F.lit("\n"), "code"), "more", "\n\n")
    name = F.format_string("recheck-%03d", "batch")
    shown = F.when(F.col("more").isNotNull(), F.concat(F.lit("\n\n## More code\n\n"), "more")).otherwise("")
    packs = claims.join(more, "batch", "left").select("batch", name.alias("name"), F.concat(F.lit("# "), name, F.lit(f"\n\n{render.SECOND_RULES}\n\n## Claims\n\n"), "claims", shown).alias("text"))
    spans = own.where("file IS NOT NULL").select("item_id", "file", "start", "end").union(kept.join(batched.select("batch", "item_id"), "batch").select("item_id", "file", "start", "end"))
    return packs, spans.distinct()


def method_windows(claims: DataFrame, methods: DataFrame, files: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(item_id, file, start, end, code): the code around each claim's first evidence: its method's part, or some lines.
    claims: item_id, evidence; methods: file, line, end_line, sym_ord; files: file, text."""
    from . import context

    first = F.get("evidence", F.lit(0))
    at = claims.select("item_id", first["file"].alias("file"), F.coalesce(F.expr("try_cast(evidence[0].line AS INT)"), F.lit(1)).alias("line"))
    lengths = files.select("file", F.size(F.split("text", "\n")).alias("n_lines"))
    spans = methods.where("end_line IS NOT NULL").select("file", F.col("line").alias("begin"), "end_line", "sym_ord")
    found = context.enclosing_span(at.join(lengths, "file"), spans, "file", "line", "begin", "end_line", "sym_ord")
    bounds = context.window_bounds(F.col("line"), F.col("span_start"), F.col("span_end"), F.col("n_lines"), config)
    rows = found.select("item_id", "file", bounds.alias("w")).select("item_id", "file", "w.start", "w.end").join(files.select("file", "text"), "file")
    part = F.slice(F.split("text", "\n"), F.col("start"), F.col("end") - F.col("start") + 1)
    code = F.array_join(F.transform(part, lambda x, i: F.concat((F.col("start") + i).cast("string"), F.lit("\t"), x)), "\n")
    return rows.select("item_id", "file", "start", "end", code.alias("code"))
