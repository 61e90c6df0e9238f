"""Scalar functions as Column expressions. Regular expressions are Unicode-aware, as requirement texts are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm_ws(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def clip(c: Column, limit: int = 60) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("…"))).otherwise(c)


def line_of(text: Column, pos: Column) -> Column:
    """The line, from 1, of a position from 0."""
    return F.size(F.split(F.substring(text, F.lit(1), pos), "\n"))


def snippet(text: Column, center: Column, before: int, size: int) -> Column:
    """Numbered lines from `before` lines over the centre, clipped to the text."""
    lines = F.split(text, "\n")
    start = F.greatest(F.lit(1), center - before)
    part = F.slice(lines, start, size)
    return F.array_join(F.transform(part, lambda x, i: F.concat((start + i).cast("string"), F.lit("\t"), x)), "\n")


# ---- paths


def norm_url(path: Column) -> Column:
    """No query, single slashes, one in front and none behind, placeholders without names."""
    # each step names the one before once: a WHEN over it would run all steps again for each branch
    p = strip(path)
    for pattern, put in ((r"(?s)\?.*$", ""), ("/{2,}", "/"), ("^(?!/)", "/"), (r"(?s)(?<=.)/\z", ""), (r"\{[^}]*\}", "{}")):
        p = F.regexp_replace(p, pattern, put)
    return p


def key_verb(key: Column) -> Column:
    return F.when(key.contains(" "), F.upper(F.substring_index(key, " ", 1))).otherwise(F.lit("ANY"))


def key_path(key: Column) -> Column:
    return F.regexp_replace(key, r"^[^ ]* ", "")


def join_path(base: Column, sub: Column) -> Column:
    b, s = strip(F.coalesce(base, F.lit(""))), strip(F.coalesce(sub, F.lit("")))
    rooted = lambda x: F.when(x.startswith("/"), x).otherwise(F.concat(F.lit("/"), x))
    both = F.concat(F.regexp_replace(b, "/+$", ""), F.lit("/"), F.regexp_replace(s, "^/+", ""))
    return F.when((b == "") & (s == ""), F.lit("/")).when(b == "", rooted(s)).when(s == "", rooted(b)).otherwise(both)


def segments(path: Column) -> Column:
    """Parts of a path that are not placeholders."""
    return F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.startswith("{"))


# ---- identifiers in requirement texts

# What a path, a type, a call, a member, an enum value and a camel-case word look like.
PATH = r"(?U)(?<![\w/])(/(?:[A-Za-z_{][\w\-{}.]*)(?:/[A-Za-z_{][\w\-{}.]*)+)"
TYPE_NAME = rf"(?U)\b([A-Z][A-Za-z0-9_]*(?:{'|'.join(S.TYPE_SUFFIXES)}))\b"
CALL = r"(?U)\b([a-z][A-Za-z0-9_]*)\s*\("
MEMBER = r"(?U)\b[A-Z]\w*\.([a-z]\w*)"
ENUM = r"(?U)\b([A-Z][A-Z0-9]*_[A-Z0-9_]+)\b"
CAMEL = r"(?U)\b([a-z][a-z0-9]*[A-Z][A-Za-z0-9]*)\b"


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def _strings(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words))


def dedupe(a: Column) -> Column:
    return F.array_distinct(F.filter(a, lambda x: x != ""))


def ticked(c: Column) -> Column:
    return _all(c, "`([^`]+)`")


def paths(c: Column, trim_tail: bool = False) -> Column:
    found = _all(c, PATH)
    return F.transform(found, lambda x: F.regexp_replace(x, r"\.+$", "")) if trim_tail else found


def guess_http(text: Column, path: Column) -> Column:
    """The first verb, in a fixed order, that stands near the first place of the path; ANY if none does."""
    pos = F.instr(text, path) - 1
    start = F.greatest(F.lit(0), pos - 40)
    window = F.upper(F.substring(text, start + 1, pos + F.length(path) + 10 - start))
    out = F.lit("ANY")
    for verb in reversed(S.HTTP_WORDS):
        out = F.when(window.contains(verb), F.lit(verb)).otherwise(out)
    return out


def error_codes(c: Column, digits: int = 5) -> Column:
    return _all(c, rf"(?U)(?<![\w.])([1-9]\d{{{digits - 1}}})(?![\w.])")


def identifiers(text: Column, digits: int = 5, trim_tail: bool = False) -> Column:
    """A struct of everything in a text that can be looked up in code. Null text has no identifiers."""
    t = F.coalesce(text, F.lit(""))
    tick = ticked(t)
    joined = F.array_join(tick, " ")
    first = F.when(joined != "", joined).otherwise(t)
    urls = F.transform(paths(t, trim_tail), lambda p: F.struct(p.alias("path"), guess_http(t, p).alias("http"), F.concat_ws(" ", guess_http(t, p), p).alias("display")))
    types = dedupe(F.concat(_all(t, TYPE_NAME), _all(joined, TYPE_NAME)))
    calls = F.filter(_all(first, CALL), lambda x: ~F.array_contains(_strings(S.CONTROL_WORDS), x))
    stop = _strings(S.CAMEL_STOPWORDS)
    named = F.filter(F.transform(tick, strip), lambda x: x.rlike("^[a-z][a-z0-9]*[A-Z][A-Za-z0-9]*$") & ~F.array_contains(stop, x))
    loose = F.filter(_all(t, CAMEL), lambda x: (F.length(x) >= 5) & ~F.array_contains(stop, x))
    return F.struct(
        urls.alias("urls"),
        types.alias("types"),
        dedupe(F.concat(calls, _all(t, MEMBER))).alias("methods"),
        dedupe(F.when(F.size(named) > 0, named).otherwise(loose)).alias("fields"),
        dedupe(error_codes(first, digits)).alias("error_codes"),
        dedupe(_all(t, ENUM)).alias("enum_values"),
    )


# ---- retrieval


def bm25_tokens(c: Column) -> Column:
    """Words of two characters and more, camel case split, and pairs of neighbouring CJK characters."""
    t = F.coalesce(c, F.lit(""))
    low = F.lower(F.when(t.rlike("[a-z0-9][A-Z]"), F.regexp_replace(t, "(?<=[a-z0-9])(?=[A-Z])", " ")).otherwise(t))
    runs = F.regexp_extract_all(low, F.lit("([一-鿿]+)"), F.lit(1))
    pairs = F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(F.regexp_extract_all(low, F.lit("([a-z][a-z0-9_]+)"), F.lit(1)), F.flatten(pairs))


# ---- Markdown scalars


def likely_requirement(kind: Column, heading: Column) -> Column:
    leaf = F.coalesce(F.try_element_at(heading, F.lit(-1)), F.lit(""))
    hinted = F.exists(_strings(S.NON_REQUIREMENT_HINTS), lambda h: leaf.contains(h))
    return (kind != "heading") & ((leaf == "") | ~hinted)


def image_refs(text: Column) -> Column:
    """Targets of image references, percent-decoded, in order and once each."""
    raw = F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(\s*([^)\s]+)"), F.lit(1))
    decoded = F.transform(raw, lambda r: F.coalesce(F.try_url_decode(F.replace(r, F.lit("+"), F.lit("%2B"))), r))
    return dedupe(decoded)
