"""Quotes against originals, merged verdicts, their placement, and the second review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..config import EngineConfig
from ..functions import text as X
from .context import in_windows, resolved_within

OK_EVIDENCE, NO_EVIDENCE, NO_FILE, EMPTY_QUOTE, OUTSIDE, NO_SUCH_FILE, BAD_LINE, MISMATCH, OFF_WINDOW = "ok", "no_evidence", "no_file", "empty_quote", "outside", "no_such_file", "bad_line", "mismatch", "off_window"


def quote_tier(quote: Column, window: Column) -> Column:
    """1: contained as it is; 2: with white space evened out; 3: of two lines or more every one contained; 0: none."""
    lines = F.filter(F.transform(F.split(quote, "\n"), X.strip), lambda x: x != "")
    every = (F.size(lines) >= 2) & F.forall(lines, lambda x: window.contains(x))
    return F.when(window.contains(quote), 1).when(X.norm_ws(window).contains(X.norm_ws(quote)), 2).when(every, 3).otherwise(0)


def quote_window(text: Column, line: Column, config: EngineConfig = EngineConfig()) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), F.greatest(line, F.lit(1)), config.quote_window), "\n")


def verify_evidence(rows: DataFrame, files: DataFrame, keys: list[str], evidence: str = "evidence", config: EngineConfig = EngineConfig()) -> DataFrame:
    """A row for each piece of evidence of `rows` (and one where there is none): keys, ev_ord, file, line, quote, problem,
    and numeric: whether a line number was given.

    Files are a table (file, text), so a path that climbs out can never be read; it keeps a problem of its own.
    """
    ev = rows.select(*keys, F.posexplode_outer(evidence).alias("ev_ord", "e"))
    quote, file = X.strip(F.coalesce("e.quote", F.lit(""))), X.strip(F.coalesce("e.file", F.lit("")))
    said = F.coalesce(F.col("e.line"), F.lit("0"))
    numeric = said.rlike(r"^\s*[+-]?\d+\s*$")
    ev = ev.select(*keys, "ev_ord", F.col("e").isNull().alias("_none"), file.alias("file"), quote.alias("quote"), numeric.alias("numeric"), F.when(numeric, F.expr("try_cast(trim(coalesce(e.line, '0')) AS INT)")).otherwise(1).alias("line"), resolved_within(file).alias("_at"))
    read = ev.join(files.select(F.col("file").alias("_file"), F.col("text").alias("_text")), F.col("_at") == F.col("_file"), "left")
    n_lines = F.size(F.split("_text", "\n"))
    tier = quote_tier(F.col("quote"), quote_window(F.col("_text"), F.col("line"), config))
    problem = (
        F.when(F.col("_none"), NO_EVIDENCE).when(F.col("file") == "", NO_FILE).when(F.col("quote") == "", EMPTY_QUOTE)
        .when(F.col("_at").isNull(), OUTSIDE).when(F.col("_file").isNull(), NO_SUCH_FILE)
        .when(F.col("line").isNull() | (F.col("line") < 1) | (F.col("line") > n_lines), BAD_LINE).when(tier == 0, MISMATCH).otherwise(OK_EVIDENCE)
    )
    return read.select(*keys, "ev_ord", "file", "line", "quote", problem.alias("problem"), "numeric")


def problems_of(verified: DataFrame, keys: list[str]) -> DataFrame:
    """keys, problems: the codes of what is wrong, in order."""
    bad = F.array_sort(F.collect_list(F.when(F.col("problem") != OK_EVIDENCE, F.struct("ev_ord", "problem"))))
    return verified.groupBy(*keys).agg(F.transform(bad, lambda x: x["problem"]).alias("problems"))


def merge_verdicts(items: DataFrame, static: DataFrame, external: DataFrame) -> DataFrame:
    """items ⟕ static ⟕ external, each a row an item: verdict, checked_by, has_evidence, problems.

    static: item_id, route, s_verdict. external: item_id, x_verdict, n_evidence, problems (an array).
    """
    rows = items.join(static, "item_id", "left").join(external, "item_id", "left")
    script, silent = F.col("route") == S.ROUTE_STATIC, F.col("x_verdict").isNull()
    bounced = F.col("x_verdict").isin("implemented", "partial", "deviated") & (F.size(F.coalesce("problems", F.array().cast("array<string>"))) > 0)
    verdict = F.when(script, F.col("s_verdict")).when(silent | bounced, "undecidable").otherwise(F.col("x_verdict"))
    by = F.when(script, S.BY_SCRIPT).when(silent, S.BY_PENDING).when(bounced, S.BY_BOUNCED).otherwise(S.BY_AI)
    return rows.withColumn("verdict", verdict).withColumn("checked_by", by)


def placement(verdict: Column, checked_by: Column, has_evidence: Column, forced: Column | None = None, config: EngineConfig = EngineConfig()) -> Column:
    """ok, fix or confirm."""
    script = checked_by == S.BY_SCRIPT
    missing = script if config.strict_missing else script | has_evidence
    own = (
        F.when(verdict == "implemented", S.PLACE_OK).when((verdict == "missing") & missing, S.PLACE_FIX)
        .when((verdict == "deviated") & (script | (checked_by == S.BY_AI)), S.PLACE_FIX).otherwise(S.PLACE_CONFIRM)
    )
    return own if forced is None else F.coalesce(forced, own)


def select_claims(merged: DataFrame) -> DataFrame:
    """Verified external verdicts that a second review is worth."""
    return merged.where((F.col("route") == S.ROUTE_AI) & F.col("verdict").isin("implemented", "deviated") & (F.col("checked_by") == S.BY_AI) & F.col("has_evidence"))


def enrich_claims(claims: DataFrame, items: DataFrame) -> DataFrame:
    """Claims with their items' text and note, empty where there is none."""
    more = items.select("item_id", F.col("text").alias("_text"), F.col("note").alias("_note"))
    return claims.join(more, "item_id", "left").withColumn("text", F.coalesce("_text", F.lit(""))).withColumn("note", F.coalesce("_note", F.lit(""))).drop("_text", "_note")


def clauses_ok(evidence: DataFrame, keys: list[str], clause: str, passes: Column) -> DataFrame:
    """keys, ok: whether each clause has a piece of evidence that passes. A clause without any is a row whose passes is
    null or false."""
    per_clause = evidence.groupBy(*keys, clause).agg(F.bool_or(F.coalesce(passes, F.lit(False))).alias("_any"))
    return per_clause.groupBy(*keys).agg(F.bool_and("_any").alias("ok"))


def effective_second(second: Column, evidence_ok: Column, clauses_pass: Column) -> Column:
    """What a second verdict counts as: unverifiable where it is unknown, its evidence fails, or, if it confirms, a
    clause stands without evidence."""
    known = second.isin("confirmed", "refuted", "partial", "unverifiable")
    good = F.coalesce(evidence_ok, F.lit(False)) | (second == "unverifiable")
    return F.when(~F.coalesce(known, F.lit(False)) | ~good, "unverifiable").when((second == "confirmed") & ~F.coalesce(clauses_pass, F.lit(False)), "unverifiable").otherwise(second)


def verify_second(rows: DataFrame, files: DataFrame, windows: DataFrame, keys: list[str], evidence: str = "evidence") -> DataFrame:
    """verify_evidence() of a second review: evidence must also begin in a window that its item was shown. keys hold
    item_id; windows: item_id, file, start, end. Evidence without a line number stands in no window."""
    checked = verify_evidence(rows, files, keys, evidence).withColumn("at_file", resolved_within(F.col("file")))
    good = checked.where((F.col("problem") == OK_EVIDENCE) & F.col("numeric"))
    shown = windows.select("item_id", F.col("file").alias("at_file"), "start", "end")
    inside = in_windows(good, shown, ["item_id", "at_file"], "line").select(*keys, "ev_ord", F.lit(True).alias("_inside"))
    off = (F.col("problem") == OK_EVIDENCE) & F.col("_inside").isNull()
    return checked.join(inside, [*keys, "ev_ord"], "left").withColumn("problem", F.when(off, OFF_WINDOW).otherwise(F.col("problem"))).drop("_inside", "at_file")


def effective_seconds(rechecks: DataFrame, files: DataFrame, windows: DataFrame) -> DataFrame:
    """(item_id, second): what each second verdict counts as, from its evidence and that of its clauses. All evidence of
    a verdict must pass; of a clause one piece is enough. rechecks: item_id, second_verdict, evidence, clauses."""
    passes = F.col("problem") == OK_EVIDENCE
    own = verify_second(rechecks.select("item_id", "evidence"), files, windows, ["item_id"]).groupBy("item_id").agg(F.bool_and(passes).alias("evidence_ok"))
    clauses = rechecks.select("item_id", F.posexplode("clauses").alias("clause", "c")).select("item_id", "clause", F.col("c.evidence").alias("evidence"))
    each = verify_second(clauses, files, windows, ["item_id", "clause"])
    rows = rechecks.select("item_id", "second_verdict").join(own, "item_id", "left").join(clauses_ok(each, ["item_id"], "clause", passes), "item_id", "left")
    return rows.select("item_id", effective_second(F.col("second_verdict"), F.col("evidence_ok"), F.col("ok")).alias("second"))


def decide(first: Column, second: Column) -> Column:
    return F.when((first == "implemented") & (second == "confirmed"), S.PLACE_OK).when((first == "deviated") & (second == "confirmed"), S.PLACE_FIX).otherwise(S.PLACE_CONFIRM)


def apply_rechecks(merged: DataFrame, seconds: DataFrame) -> DataFrame:
    """merged with forced placements of claims. seconds: item_id, second (effective). Without any row nothing changes:
    whether there is one is a scalar of the plan, not an action."""
    any_row = seconds.agg((F.count("*") > 0).alias("_any"))
    eligible = (F.col("route") == S.ROUTE_AI) & F.col("verdict").isin("implemented", "deviated") & (F.col("checked_by") == S.BY_AI) & F.col("has_evidence")
    rows = merged.join(seconds.select("item_id", F.col("second").alias("_second")), "item_id", "left").join(F.broadcast(any_row))
    touched = F.col("_any") & eligible
    second = F.coalesce("_second", F.lit("unverifiable"))
    forced = F.when(touched, decide(F.col("verdict"), second))
    by = F.when(touched, F.concat(F.lit(S.BY_RECHECK + ":"), second)).otherwise(F.col("checked_by"))
    return rows.withColumn("forced_placement", forced).withColumn("checked_by", by).drop("_second", "_any")
