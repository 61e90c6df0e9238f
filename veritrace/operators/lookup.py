"""Identifiers against the symbol index: exact, path and nearest lookups, and the static verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas as S
from ..functions import text as X

# identifier families in the order in which an existence item takes its primary one, and in which checks are listed
PRIMARY_ORDER = ("urls", "types", "methods", "error_codes", "enum_values", "fields")
CHECK_ORDER = ("urls", "types", "methods", "fields", "error_codes", "enum_values")
#: family of identifiers -> family of symbols
SYMBOL_FAMILY = {"urls": "urls", "types": "types", "methods": "methods", "fields": "fields", "error_codes": "error_codes", "enum_values": "enum_constants"}
BEHAVIOR_SITES, EXISTENCE_SITES = 8, 10


def exact_lookup(wanted: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """wanted ⟕ symbols on keys, case-sensitive: one row a hit, or one with null columns."""
    return wanted.join(symbols, keys, "left")


def url_lookup(wanted: DataFrame, urls: DataFrame) -> DataFrame:
    """wanted (path, http) ⟕ urls (key): equal normalised paths, and a verb that does not conflict; the path itself is
    the join key, the verb a residual condition."""
    u = urls.withColumn("_norm", X.norm_url(X.key_path(F.col("key")))).withColumn("_verb", X.key_verb(F.col("key")))
    verb = F.upper(X.strip(F.coalesce(F.col("http"), F.lit(""))))
    w = wanted.withColumn("_wanted", X.norm_url(F.col("path"))).withColumn("_asked", verb)
    match = (F.col("_wanted") == F.col("_norm")) & (F.col("_asked").isin("", "ANY") | F.col("_verb").isin("ANY") | (F.col("_verb") == F.col("_asked")))
    return w.join(u.drop("path", "http") if "path" in urls.columns else u, match, "left").drop("_wanted", "_asked", "_norm", "_verb")


def url_hits(wanted: DataFrame, urls: DataFrame) -> DataFrame:
    """wanted (path, http) with n_hits and first_hit, the least ord, of what url_lookup() would find in urls (key, ord).

    Endpoints are counted by path and verb before they are met, so that a path of many endpoints is a row for each verb.
    """
    u = urls.groupBy(X.norm_url(X.key_path(F.col("key"))).alias("_norm"), X.key_verb(F.col("key")).alias("_verb")).agg(F.count("ord").alias("_n"), F.min("ord").alias("_first"))
    n = u.groupBy("_norm").agg(F.map_from_entries(F.collect_list(F.struct("_verb", F.struct("_n", "_first")))).alias("_verbs"))
    asked = F.upper(X.strip(F.coalesce(F.col("http"), F.lit(""))))
    rows = wanted.join(n, X.norm_url(F.col("path")) == F.col("_norm"), "left")
    fit = F.map_values(F.map_filter("_verbs", lambda verb, _: asked.isin("", "ANY") | verb.isin("ANY") | (verb == asked)))
    count = F.aggregate(fit, F.lit(0).cast("bigint"), lambda acc, x: acc + x["_n"])
    return rows.select(*wanted.columns, F.coalesce(count, F.lit(0)).alias("n_hits"), F.array_min(F.transform(fit, lambda x: x["_first"])).alias("first_hit"))


def register_urls(bases: DataFrame, subs: DataFrame, keys: list[str]) -> DataFrame:
    """key, path of every base path × sub path of one owner: bases (keys, base), subs (keys, sub, http)."""
    if not keys:
        raise ValueError("base paths belong to an owner: without a key all would meet all")
    path = X.join_path(F.col("base"), F.col("sub"))
    both = subs.join(bases, keys)
    return both.withColumn("path", path).withColumn("key", F.concat_ws(" ", F.coalesce("http", F.lit("ANY")), "path"))


GRAM = 3


def _grams(c: Column, size: int) -> Column:
    n = F.length(c)
    return F.array_distinct(F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(size)))).otherwise(F.array().cast("array<string>")))


def _inside(short: DataFrame, long: DataFrame, by: list[str], s: str, t: str) -> DataFrame:
    """Rows of `short` beside rows of `long` whose string t holds their string s and is longer.

    They meet on one gram of s: the rarest of its GRAM-grams by how many rows of `long` hold it, or s itself where it is
    no longer than a gram.
    """
    sizes = [F.transform(_grams(F.col(t), n), lambda g: g) for n in range(1, GRAM + 1)]
    held = long.withColumn("g", F.explode(F.concat(*sizes)))
    rarity = held.where(F.length("g") == GRAM).groupBy(*by, "g").agg(F.count("*").alias("_df"))
    own = short.where(F.length(s) > GRAM).withColumn("g", F.explode(_grams(F.col(s), GRAM))).join(rarity, [*by, "g"], "left")
    # a gram that no row holds settles it: it is the rarest, and the string is in none
    best = own.groupBy(*short.columns).agg(F.min_by("g", F.struct(F.coalesce("_df", F.lit(0)), "g")).alias("g"))
    few = short.where((F.length(s) <= GRAM) & (F.length(s) > 0)).withColumn("g", F.col(s))
    return best.unionByName(few).join(held, [*by, "g"]).where(F.col(t).contains(F.col(s)) & (F.col(s) != F.col(t))).drop("g")


def nearest_names(missed: DataFrame, names: DataFrame, limit: int = 3, by: list[str] = []) -> DataFrame:
    """For each missed target the first `limit` names, by ord, that hold it or that it holds, case aside, without those
    equal to it: (by, target, name, name_ord, rank). names: (by, name, name_ord), a row a name; `by` must be equal."""
    targets = missed.select(*by, "target", F.lower("target").alias("t")).distinct()
    named = names.select(*by, "name", "name_ord", F.lower("name").alias("n"))
    columns = [*by, "target", "name", "name_ord"]
    found = _inside(targets, named, by, "t", "n").select(*columns).union(_inside(named, targets, by, "n", "t").select(*columns))
    rank = F.row_number().over(Window.partitionBy(*by, "target").orderBy("name_ord", "name"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= limit).select(*columns, "rank")


def nearest_urls(missed: DataFrame, urls: DataFrame, limit: int = 3) -> DataFrame:
    """For each missed path the first `limit` paths that start with its first segment: (target, path, path_ord, rank).

    `startswith` on a prefix of varying length becomes an equi-join: each path is looked up by its own prefixes.
    """
    first = F.concat(F.lit("/"), F.try_element_at(F.filter(F.split("target", "/"), lambda s: s != ""), F.lit(1)))
    t = missed.select("target", first.alias("prefix")).where(F.col("prefix").isNotNull()).distinct()
    own = F.transform(F.sequence(F.lit(2), F.greatest(F.length("path"), F.lit(2))), lambda i: F.substring("path", F.lit(1), i))
    p = urls.where(F.col("path").startswith("/")).select("path", "path_ord", F.explode(F.array_distinct(own)).alias("prefix"))
    rank = F.row_number().over(Window.partitionBy("target").orderBy("path_ord", "path"))
    return t.join(p, "prefix").withColumn("rank", rank).where(F.col("rank") <= limit).select("target", "path", "path_ord", "rank")


def primary(ids: Column) -> Column:
    """The first family of identifiers that is not empty, or null."""
    out = F.lit(None).cast("string")
    for family in reversed(PRIMARY_ORDER):
        out = F.when(F.size(ids[family]) > 0, F.lit(family)).otherwise(out)
    return out


def _family_checks(values: Column, n: int, family: str) -> Column:
    def one(x: Column) -> Column:
        target, http = (x["path"], x["http"]) if family == "urls" else (x, F.lit(""))
        return F.struct(F.lit(n).alias("family_ord"), F.lit(family).alias("family"), target.alias("target"), http.alias("http"))

    return F.transform(values, one)


def checks(items: DataFrame, ids: str = "ids") -> DataFrame:
    """One row a check: item_id, kind, family, check_ord, target, http. Existence items are checked by their primary
    family only."""
    rows = [_family_checks(F.col(ids)[family], n, family) for n, family in enumerate(CHECK_ORDER)]
    all_checks = F.concat(*rows)
    own = F.when((F.col("kind") == "existence"), F.filter(all_checks, lambda c: c["family"] == primary(F.col(ids)))).otherwise(all_checks)
    return items.select("item_id", "kind", F.posexplode(own).alias("check_ord", "c")).select("item_id", "kind", "check_ord", "c.*")


#: Sites that a check's hits keep; the count of hits is of all.
SITES = 10
_SITE = "STRUCT<sym_ord:BIGINT,file:STRING,line:INT,owner:STRING,handler:STRING>"


def _symbol_keys(symbols: DataFrame) -> DataFrame:
    """symbols with what checks ask for: family, key (a normalised path for endpoints) and verb."""
    url = F.col("family") == "urls"
    key = F.when(url, X.norm_url(X.key_path(F.col("name")))).otherwise(F.col("name"))
    return symbols.select(F.col("family").alias("_s_family"), key.alias("_s_key"), F.when(url, X.key_verb(F.col("name"))).otherwise("ANY").alias("_s_verb"), "sym_ord", "file", "line", "owner", "handler")


def _asked(all_checks: DataFrame) -> tuple[DataFrame, Column]:
    """checks with the key they ask for, and the condition on _symbol_keys()."""
    family = F.create_map(*[F.lit(x) for pair in SYMBOL_FAMILY.items() for x in pair])
    key = F.when(F.col("family") == "urls", X.norm_url(F.col("target"))).otherwise(F.col("target"))
    wanted = all_checks.withColumn("_family", F.element_at(family, F.col("family"))).withColumn("_key", key)
    verb = F.upper(X.strip(F.coalesce("http", F.lit(""))))
    return wanted, (F.col("_family") == F.col("_s_family")) & (F.col("_key") == F.col("_s_key")) & (verb.isin("", "ANY") | F.col("_s_verb").isin("ANY") | (F.col("_s_verb") == verb))


def hit_sites(all_checks: DataFrame, symbols: DataFrame) -> DataFrame:
    """A row for each hit of each check: checks' columns, sym_ord, file, line, owner, handler."""
    wanted, fits = _asked(all_checks)
    return wanted.join(_symbol_keys(symbols), fits).select(*all_checks.columns, "sym_ord", F.col("file"), "line", "owner", "handler")


def run_checks(all_checks: DataFrame, symbols: DataFrame) -> DataFrame:
    """checks with n_hits and hits: the first SITES different places in index order as an array of (sym_ord, file, line,
    owner, handler), empty where nothing was found.

    Symbols of one key are counted and cut to their first places before they meet the checks, so a name that stands in
    a third of all code is one row there.
    """
    keyed, group = _symbol_keys(symbols), ["_s_family", "_s_key", "_s_verb"]
    places = keyed.groupBy(*group, "file", "line").agg(F.min_by(F.struct("owner", "handler"), "sym_ord").alias("o"), F.min("sym_ord").alias("sym_ord"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("sym_ord"))
    first = places.withColumn("rank", rank).where(F.col("rank") <= SITES)
    site = F.struct("sym_ord", "file", "line", F.col("o.owner").alias("owner"), F.col("o.handler").alias("handler")).cast(_SITE)
    sites = first.groupBy(*group).agg(F.collect_list(site).alias("sites"))
    index = places.groupBy(*group).agg(F.sum("n").alias("n")).join(sites, group)
    wanted, fits = _asked(all_checks)
    joined = wanted.join(index, fits, "left").groupBy(*all_checks.columns).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_hits"), F.flatten(F.collect_list("sites")).alias("all"))
    return joined.select(*all_checks.columns, "n_hits", F.slice(F.array_sort("all"), 1, SITES).alias("hits"))


def nearest_on_miss(checked: DataFrame, symbols: DataFrame, limit: int = 3) -> DataFrame:
    """checks with `nearest`, what the index has that is like a target without a hit: (name, file, line) of the first
    place of each name. Error codes have none."""
    family = F.create_map(*[F.lit(x) for pair in SYMBOL_FAMILY.items() for x in pair])
    missed = checked.where((F.col("n_hits") == 0) & (F.col("family") != "error_codes")).select(F.element_at(family, F.col("family")).alias("s_family"), "target").distinct()
    plain = symbols.where("family NOT IN ('urls', 'error_codes')").groupBy(F.col("family").alias("s_family"), "name").agg(F.min("sym_ord").alias("name_ord"), F.min_by(F.struct("file", "line"), "sym_ord").alias("at"))
    urls = symbols.where("family = 'urls'").groupBy(X.key_path(F.col("name")).alias("name")).agg(F.min("sym_ord").alias("name_ord"), F.min_by(F.struct("file", "line"), "sym_ord").alias("at"))
    by_name = nearest_names(missed.where("s_family != 'urls'"), plain, limit, ["s_family"]).join(plain.select("s_family", "name", "at"), ["s_family", "name"])
    by_path = nearest_urls(missed.where("s_family = 'urls'"), urls.select(F.col("name").alias("path"), F.col("name_ord").alias("path_ord")), limit)
    by_path = by_path.join(urls.select(F.col("name").alias("path"), "at"), "path").select(F.lit("urls").alias("s_family"), "target", F.col("path").alias("name"), "rank", "at")
    both = by_name.select("s_family", "target", "name", "rank", "at").unionByName(by_path)
    one = F.struct("rank", "name", F.col("at.file").alias("file"), F.col("at.line").alias("line"))
    lists = both.groupBy("s_family", "target").agg(F.array_sort(F.collect_list(one)).alias("_near"))
    named = F.transform("_near", lambda x: F.struct(x["name"].alias("name"), x["file"].alias("file"), x["line"].alias("line")))
    rows = checked.withColumn("s_family", F.element_at(family, F.col("family"))).join(lists, ["s_family", "target"], "left")
    near = F.when((F.col("n_hits") == 0) & F.col("_near").isNotNull(), named).otherwise(F.array().cast("array<struct<name:string,file:string,line:int>>"))
    return rows.select(*checked.columns, near.alias("nearest"))


def flatten_hits(checked: DataFrame) -> DataFrame:
    """evidence of each item: its hits in order, once for each (file, line), the first few."""
    hits = checked.select("item_id", "kind", "check_ord", "target", F.posexplode("hits").alias("hit_ord", "hit"))
    first = Window.partitionBy("item_id", "hit.file", "hit.line").orderBy("check_ord", "hit_ord")
    once = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("check_ord", "hit_ord"))
    most = F.when(F.col("kind") == "existence", EXISTENCE_SITES).otherwise(BEHAVIOR_SITES)
    few = once.withColumn("_rank", rank).where(F.col("_rank") <= most)
    site = F.struct("_rank", F.col("hit.file").alias("file"), F.col("hit.line").alias("line"), "target")
    return few.groupBy("item_id").agg(F.array_sort(F.collect_list(site)).alias("evidence"))


def static_verdicts(items: DataFrame, checked: DataFrame) -> DataFrame:
    """item_id, route, verdict, reason of items (item_id, kind), from how many of their checks were hit."""
    hits = F.col("n_hits")
    sums = checked.groupBy("item_id").agg(
        F.count("*").alias("n"), F.count_if(hits > 0).alias("found"), F.max(hits).alias("most"),
        F.array_sort(F.collect_list(F.when(hits == 0, F.struct("check_ord", "target")))).alias("missed"),
    )
    rows = items.select("item_id", "kind").join(sums, "item_id", "left")
    existence, n = F.col("kind") == "existence", F.coalesce("n", F.lit(0))
    verdict = (
        F.when(~existence | (n == 0), "need_ai").when(F.col("found") == 0, "missing")
        .when((F.col("found") == n) & (F.col("most") > 1), "ambiguous").when(F.col("found") == n, "implemented").otherwise("partial")
    )
    names = F.array_join(F.transform("missed", lambda m: m["target"]), ", ")
    reason = F.when(verdict.isin("missing", "partial"), F.concat(F.lit("not found: "), names)).otherwise("")
    route = F.when(verdict.isin("missing", "implemented"), S.ROUTE_STATIC).otherwise(S.ROUTE_AI)
    return rows.select("item_id", "kind", route.alias("route"), verdict.alias("verdict"), reason.alias("reason"))


def summarize(static: DataFrame) -> DataFrame:
    """Items by route and verdict."""
    return static.groupBy("route", "verdict").agg(F.count("*").alias("n_items"))


def search_log(items: DataFrame, scope: list[str], n_files: Column, ids: str = "ids") -> DataFrame:
    """What was searched for each item: roots, number of files, families and keywords in order."""
    i = F.col(ids)
    words = F.array_distinct(F.concat(F.transform(i["urls"], lambda u: u["path"]), i["types"], i["methods"], i["fields"], i["error_codes"], i["enum_values"]))
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    said = F.struct(strings(scope).alias("scope"), n_files.cast("bigint").alias("file_count"), strings(CHECK_ORDER).alias("indexes_searched"), words.alias("keywords"))
    return items.select("item_id", said.alias("search_log"))
