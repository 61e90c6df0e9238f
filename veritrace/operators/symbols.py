"""Java sources as a table of symbols.

A file is read once into tokens by one pattern; brackets are paired in one pass. Types are then found wherever they
stand, and the members of each type body are read statement by statement, bracketed parts skipped by their pairs. A file
is a row; registering endpoints (base paths x sub paths) and numbering are table operations.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schemas as S
from ..config import EngineConfig
from ..functions import text as X

TYPE_WORDS = frozenset(("class", "interface", "enum", "record"))

TOKEN = re.compile(
    r'(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<block>""".*?(?:(?<!\\)"""|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"?)'
    r"|(?P<char>'(?:\\.|[^'\\\n])*'?)|(?P<id>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<op>\S)",
    re.S | re.A,
)
_CLOSE = {"(": ")", "{": "}", "[": "]"}


@dataclass
class Token:
    kind: str
    text: str
    pos: int
    doc: str = ""

    def op(self, *chars: str) -> bool:
        return self.kind == "op" and self.text in chars


def clean_comment(raw: str) -> str:
    body = raw[2:] if raw.startswith("//") else raw[2:].removesuffix("*/")
    return " ".join(s for s in (line.strip().lstrip("*").strip() for line in body.split("\n")) if s)


def tokenize(source: str) -> list[Token]:
    """Tokens without comments and characters; a comment is the doc of the token after it, the last one wins."""
    out: list[Token] = []
    doc = ""
    for m in TOKEN.finditer(source):
        kind, text = m.lastgroup, m.group()
        if kind == "comment":
            doc = clean_comment(text)
        elif kind != "char":
            if kind in ("block", "string"):
                n = 3 if kind == "block" else 1
                kind, text = "string", text[n:].removesuffix('"' * n)
            out.append(Token(kind, text, m.start(), doc))
            doc = ""
    return out


def paired(tokens: list[Token]) -> dict[int, int]:
    """Closing position of each opening bracket and the other way round; an unclosed one reaches to the last token."""
    pairs: dict[int, int] = {}
    open_: dict[str, list[int]] = {"(": [], "{": [], "[": []}
    back = {c: o for o, c in _CLOSE.items()}
    for i, t in enumerate(tokens):
        if t.op(*_CLOSE):
            open_[t.text].append(i)
        elif t.op(*back) and open_[back[t.text]]:
            o = open_[back[t.text]].pop()
            pairs[o], pairs[i] = i, o
    for rest in open_.values():
        for o in rest:
            pairs[o] = len(tokens) - 1
    return pairs


@dataclass
class Source:
    tokens: list[Token]
    pairs: dict[int, int]
    ends: list[int]

    @classmethod
    def of(cls, source: str) -> Source:
        tokens = tokenize(source)
        return cls(tokens, paired(tokens), [m.start() for m in re.finditer("\n", source)])

    def line(self, i: int) -> int:
        return bisect_left(self.ends, self.tokens[i].pos) + 1

    def annotations(self, start: int, end: int) -> tuple[list[tuple[str, list[str]]], int]:
        """(name, string arguments) of the annotations that lead a statement, and where they end."""
        t, out, i = self.tokens, [], start
        while i + 1 < end and t[i].op("@") and t[i + 1].kind == "id" and t[i + 1].text != "interface":
            name, i = t[i + 1].text, i + 2
            while i + 1 < end and t[i].op(".") and t[i + 1].kind == "id":
                name, i = t[i + 1].text, i + 2
            args: list[str] = []
            if i < end and t[i].op("("):
                close = self.pairs[i]
                args, i = [x.text for x in t[i:close] if x.kind == "string"], close + 1
            out.append((name, args))
        return out, i

    def statement_start(self, at: int) -> int:
        """After the last `;`, `{` or `}` before `at` that is not in an annotation's parentheses."""
        i = at - 1
        while i >= 0:
            if self.tokens[i].op(")") and i in self.pairs:
                i = self.pairs[i]
            elif self.tokens[i].op(";", "{", "}"):
                return i + 1
            i -= 1
        return 0

    def body(self, at: int) -> int | None:
        """The `{` of a type whose name stands at `at`; None where `;` comes first."""
        i, generic = at + 1, 0
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.op("("):
                i = self.pairs[i]
            elif t.op("<", ">"):
                generic += 1 if t.text == "<" else -1
            elif t.op(";"):
                return None
            elif t.op("{") and generic <= 0:
                return i
            i += 1
        return None

    def is_type(self, i: int) -> bool:
        t = self.tokens
        return t[i].kind == "id" and t[i].text in TYPE_WORDS and i + 1 < len(t) and t[i + 1].kind == "id" and not (i and t[i - 1].op("."))

    def method_name(self, start: int, end: int) -> int | None:
        """Position of the name before the first parenthesis, if no `=` comes first."""
        for i in range(start, end):
            if self.tokens[i].op("="):
                return None
            if self.tokens[i].op("("):
                return i - 1 if i > start and self.tokens[i - 1].kind == "id" else None
        return None

    def field_names(self, start: int, end: int) -> list[int]:
        """Names that a field statement declares: the last of each part before `=`; the first part has a type as well."""
        out, ids, generic, value, i = [], [], 0, False, start
        first = True

        def take() -> None:
            if ids and (not first or len(ids) > 1):
                out.append(ids[-1])

        while i < end:
            t = self.tokens[i]
            if i in self.pairs and t.op(*_CLOSE):
                i = self.pairs[i]
            elif t.op("<", ">"):
                generic += 1 if t.text == "<" else -1
            elif t.op(",") and generic <= 0:
                take()
                first, ids, value = False, [], False
            elif t.op("=") and not value:
                value = True
            elif t.kind == "id" and not value and generic <= 0:
                ids.append(i)
            i += 1
        take()
        return out


@dataclass
class Found:
    types: list[dict] = field(default_factory=list)
    methods: list[dict] = field(default_factory=list)
    fields: list[dict] = field(default_factory=list)
    enum_constants: list[dict] = field(default_factory=list)


def _constants(src: Source, start: int, close: int, lenient: bool, owner: str, out: Found) -> int:
    """Reads an enum's constants up to the first `;` and returns where its members begin."""
    stop, i, names, fresh = None, start, [], True
    while i < close:
        t = src.tokens[i]
        if t.op(";"):
            stop = i
            break
        if t.op("@"):
            i = src.annotations(i, close)[1]
            continue
        if t.op(*_CLOSE):
            i = src.pairs[i]
        elif t.op(","):
            fresh = True
        elif t.kind == "id" and fresh:
            names.append(i)
            fresh = False
        i += 1
    if stop is not None or lenient:
        out.enum_constants += [{"name": src.tokens[n].text, "line": src.line(n), "owner": owner} for n in names]
    return close if stop is None else stop + 1


def _members(src: Source, start: int, close: int, owner: str, out: Found) -> None:
    def method(at: int, begin: int, last: int, notes: list) -> None:
        out.methods.append({"name": src.tokens[at].text, "line": src.line(at), "end_line": src.line(last), "owner": owner, "doc": src.tokens[begin].doc, "annotations": notes})

    i = begin = start
    while i < close:
        t = src.tokens[i]
        if t.op("(", "["):
            i = src.pairs[i]
        elif t.op(";"):
            notes, head = src.annotations(begin, i)
            name = src.method_name(head, i)
            if name is not None:
                method(name, begin, i, notes)
            else:
                out.fields += [{"name": src.tokens[n].text, "line": src.line(n), "owner": owner} for n in src.field_names(head, i)]
            begin = i + 1
        elif t.op("{"):
            end = src.pairs[i]
            notes, head = src.annotations(begin, i)
            if any(src.is_type(k) for k in range(head, i)):
                begin = end + 1
            else:
                name = src.method_name(head, i)
                if name is not None:
                    method(name, begin, end, notes)
                    begin = end + 1
                elif not any(x.op("=") for x in src.tokens[head:i]):
                    begin = end + 1
            i = end
        i += 1


def parse(source: str, lenient_enum: bool = False) -> Found:
    """All types of a source, wherever they stand, with their own members."""
    src, out = Source.of(source), Found()
    for i in range(len(src.tokens)):
        if not src.is_type(i):
            continue
        name, start = src.tokens[i + 1].text, src.statement_start(i)
        brace = src.body(i + 1)
        if brace is None:
            continue
        notes, _ = src.annotations(start, i)
        base = [a for n, args in notes if n in S.MAPPINGS for a in args if a.startswith("/")]
        out.types.append({"name": name, "line": src.line(i + 1), "kind": src.tokens[i].text, "doc": src.tokens[start].doc, "base_paths": base})
        close = src.pairs[brace]
        begin = _constants(src, brace + 1, close, lenient_enum, name, out) if src.tokens[i].text == "enum" else brace + 1
        _members(src, begin, close, name, out)
    return out


_RAW = "file STRING, seq BIGINT, family STRING, name STRING, line INT, end_line INT, owner STRING, kind STRING, doc STRING, verb STRING, base_paths ARRAY<STRING>, sub_paths ARRAY<STRING>"
_NAMES = [part.split()[0] for part in _RAW.split(", ")]


def _rows(file: str, source: str, lenient: bool) -> list[dict]:
    found = parse(source, lenient)
    bases = {t["name"]: t["base_paths"] for t in found.types}  # of equal names the last
    rows = [t | {"family": "types"} for t in found.types]
    for m in found.methods:
        rows.append(m | {"family": "methods"})
        for name, args in m["annotations"]:
            if name in S.MAPPINGS:
                rows.append({"family": "urls", "name": m["name"], "line": m["line"], "owner": m["owner"], "verb": S.MAPPINGS[name], "base_paths": bases.get(m["owner"]) or [""], "sub_paths": [a for a in args if a.startswith("/")] or [""]})
    rows += [f | {"family": "fields"} for f in found.fields] + [e | {"family": "enum_constants"} for e in found.enum_constants]
    return [{"file": file, "seq": n} | {k: v for k, v in r.items() if k in _NAMES} for n, r in enumerate(rows)]


def java_symbols(files: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """symbols (without sym_ord: file and seq order them) of Java files (file, text)."""
    kind = S.schema(_RAW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(kind)
        for batch in batches:
            for name, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_pylist(_rows(name, body or "", config.lenient_enum), schema)

    raw = files.select("file", "text").mapInArrow(run, kind)
    columns = ["file", "seq", "family", "name", "line", "end_line", "owner", "kind", "doc"]
    plain = raw.where("family != 'urls'").select(*columns, F.lit(None).cast("string").alias("handler"), F.lit(None).cast("string").alias("http"))
    urls = raw.where("family = 'urls'").withColumn("base", F.explode("base_paths")).withColumn("sub", F.explode("sub_paths"))
    path = X.join_path(F.col("base"), F.col("sub"))
    urls = urls.select("file", "seq", "family", F.concat_ws(" ", "verb", path).alias("name"), "line", "end_line", "owner", "kind", "doc", F.col("name").alias("handler"), F.col("verb").alias("http"))
    return plain.unionByName(urls).unionByName(error_codes(files, config))


def error_codes(files: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Error codes in raw texts with their lines, comments and strings included."""
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("at", "row"))
    codes = lines.select("file", "at", F.posexplode(X.error_codes(F.col("row"), config.error_code_digits)).alias("n", "name"))
    none = lambda kind: F.lit(None).cast(kind)
    seq = F.lit(1 << 40) + F.col("at").cast("long") * (1 << 16) + F.col("n")
    return codes.select("file", seq.alias("seq"), F.lit("error_codes").alias("family"), "name", (F.col("at") + 1).cast("int").alias("line"), none("int").alias("end_line"), none("string").alias("owner"), none("string").alias("kind"), none("string").alias("doc"), none("string").alias("handler"), none("string").alias("http"))


def mapper_statements(files: DataFrame) -> DataFrame:
    """(file, namespace, kind, stmt_id, line) of the statements of mapper files (file, text)."""
    space = F.regexp_extract("text", r'<mapper[^>]*\bnamespace\s*=\s*"([^"]+)"', 1)
    # split before each statement: what stands in front of a part gives its line
    parts = F.split("text", r'(?i)(?=<(?:select|insert|update|delete)\b[^>]*\bid\s*=\s*"[^"]+")')
    rows = files.select("file", space.alias("namespace"), parts.alias("parts")).select("file", "namespace", "parts", F.posexplode("parts").alias("n", "part"))
    before = F.size(F.split(F.array_join(F.slice("parts", 1, F.col("n")), ""), "\n"))
    head = r'(?i)^<(select|insert|update|delete)\b[^>]*\bid\s*=\s*"([^"]+)"'
    found = rows.where(F.col("part").rlike(head))
    return found.select("file", "namespace", F.lower(F.regexp_extract("part", head, 1)).alias("kind"), F.regexp_extract("part", head, 2).alias("stmt_id"), before.cast("int").alias("line"))


def numbered(symbols: DataFrame) -> DataFrame:
    """symbols with sym_ord: files in the order of their path components, then as they stand."""
    from .ordering import dense_ids

    return dense_ids(symbols, F.split("file", "/"), [F.col("seq"), F.col("name")], "sym_ord")


def index_summary(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, distinct type and method names, distinct endpoint keys."""
    own = lambda family: F.count_distinct(F.when(F.col("family") == family, F.col("name")))
    return symbols.agg(own("types").alias("n_types"), own("methods").alias("n_methods"), own("urls").alias("n_urls")).join(files.agg(F.count("*").alias("n_files")))


def _stamps(path: str, stamp: str, size: str) -> Column:
    return F.concat_ws(":", path, F.col(stamp).cast("string"), F.col(size).cast("string"))


def fingerprint(files: DataFrame, path: str = "file", stamp: str = "mtime", size: str = "size", config: EngineConfig = EngineConfig()) -> DataFrame:
    """sha1 over `path:stamp:size` of all files in string order, and over what changes an index besides: one row. The form
    for small trees: a line of every file meets in one task. tree_fingerprint() has no such bound."""
    joined = F.array_join(F.array_sort(F.collect_list(_stamps(path, stamp, size))), "\n")
    return files.agg(F.sha1(F.concat(F.lit(f"digits={config.error_code_digits}\n"), joined)).alias("fingerprint"))


def tree_fingerprint(files: DataFrame, path: str = "file", stamp: str = "mtime", size: str = "size", config: EngineConfig = EngineConfig()) -> DataFrame:
    """As fingerprint(), over digests of buckets of files: one row. A file's bucket is the beginning of its path's sha1, so
    65,536 buckets at most meet in the last task, and one bucket's lines in each before."""
    said = files.select(F.left(F.sha1(path), F.lit(4)).alias("bucket"), _stamps(path, stamp, size).alias("said"))
    buckets = said.groupBy("bucket").agg(F.sha1(F.array_join(F.array_sort(F.collect_list("said")), "\n")).alias("digest"))
    joined = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "bucket", "digest"))), "\n")
    return buckets.agg(F.sha1(F.concat(F.lit(f"digits={config.error_code_digits}\n"), joined)).alias("fingerprint"))
