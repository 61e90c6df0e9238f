"""Files as tables: Markdown, code and the JSON that reviewers fill in."""

from __future__ import annotations

import functools
import posixpath
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import text as X


def _path(uri: str) -> str:
    """A path without its scheme and authority, the way all parts of a listing are compared."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", uri).rstrip("/") or "/"


def _common(roots: list[str]) -> str:
    """The folder that holds all roots: a single folder itself, of a single file its folder."""
    if len(roots) == 1:
        return roots[0]
    return posixpath.commonpath(roots)


def read_texts(spark: SparkSession, roots: str | list[str], suffixes: tuple[str, ...], skip_dirs: tuple[str, ...] = (), skip_prefix: str | None = None, base: str | None = None) -> DataFrame:
    """(file, text, mtime, size, path, input) of the files below the roots with one of the suffixes, case aside; a root
    that is a file is taken whatever its suffix.

    A file is known by its resolved path, so one that several roots hold is read once, for the first of them. `file` is
    its path relative to `base` (the folder that holds all roots, unless given), or the path itself outside of it.
    Invalid UTF-8 becomes U+FFFD, line ends become newlines. Directories are skipped by their parts below the root.
    Spark's listing itself leaves out names that begin with `_` or `.`.
    """
    from ..operators.ordering import first_per_key

    roots = [roots] if isinstance(roots, str) else roots
    if not roots:
        raise ValueError("no input")
    parts = []
    for n, root in enumerate(roots):
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        path = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
        below = F.substring(path, len(_path(root)) + 1, 1 << 30)
        fits = (path == _path(root)) | F.lower(path).rlike("(" + "|".join(_quoted(s) for s in suffixes) + ")$")
        if skip_dirs:
            fits = fits & ~F.arrays_overlap(F.split(below, "/"), F.array(*map(F.lit, skip_dirs)))
        if skip_prefix:
            fits = fits & ~F.ltrim(below, F.lit("/")).startswith(skip_prefix)
        text = X.newlines(F.make_valid_utf8(F.col("content").cast("string")))
        parts.append(raw.where(fits).select(path.alias("path"), text.alias("text"), F.unix_micros("modificationTime").alias("mtime"), F.col("length").alias("size"), F.lit(n).alias("input")))
    rows = first_per_key(functools.reduce(DataFrame.union, parts), ["path"], [F.col("input")]) if len(parts) > 1 else parts[0]
    return rows.select(relative_name(F.col("path"), _path(base) if base else _common([*map(_path, roots)])).alias("file"), "text", "mtime", "size", "path", "input")


def relative_name(path: Column, base: str, outside: str = "path") -> Column:
    """A path below `base` without it. Outside: the path, or with outside="name" its last part."""
    last = F.element_at(F.split(path, "/"), -1)
    inside = F.lit(base.rstrip("/") + "/")
    return F.when(path == base, last).when(path.startswith(inside), F.substring(path, len(base.rstrip("/")) + 2, 1 << 30)).otherwise(path if outside == "path" else last)


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def read_markdown(spark: SparkSession, roots: str | list[str], work_dir: str = ".veritrace/", base: str | None = None) -> DataFrame:
    """Requirement documents of the inputs, once each, without our own work folder."""
    return read_texts(spark, roots, (".md", ".markdown"), skip_prefix=work_dir, base=base)


def read_code(spark: SparkSession, roots: str | list[str], suffixes: tuple[str, ...] = (".java", ".xml"), base: str | None = None) -> DataFrame:
    """Code of the inputs, without folders of builds and tests."""
    return read_texts(spark, roots, suffixes, S.SKIP_DIRS, base=base)


def read_json_rows(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Rows of JSON files that hold a list, with file and pos; a missing folder or malformed file gives none."""
    schema = S.schema(ddl)
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType([T.StructField("file", T.StringType()), T.StructField("pos", T.IntegerType()), *schema.fields]))
    # element by element: one that is no object leaves the others alone
    parts = raw.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.from_json("value", "ARRAY<STRING>")).alias("pos", "one"))
    rows = parts.where(F.ltrim("one").startswith("{")).select("file", "pos", F.from_json("one", schema).alias("r"))
    return rows.where(F.col("r").isNotNull()).select("file", "pos", "r.*")
