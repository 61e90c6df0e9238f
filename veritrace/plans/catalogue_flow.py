"""Registered queries, continued: files and snapshots, packs, recall, second review, reports, and the verbs end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..config import EngineConfig
from ..functions import text as X
from ..operators import blocks as B
from ..operators import context, lookup, packs, render, retrieval, symbols, verdict
from ..sources import files as files_
from ..sources import index, results, sinks
from ..sources.scratch import put_text, scratch_path
from . import verbs
from .catalogue import big, query, table

def _none():
    return F.lit(None).cast("string")


def _put(spark: SparkSession, label: str, texts: dict[str, str]) -> str:
    top = scratch_path(spark, label)
    for name, text in texts.items():
        put_text(spark, f"{top}/{name}", text)
    return top


# ---- files


@query("SELECT file, text, input FROM (VALUES ('a/README.md', 'first' || chr(10) || 'line', 0), ('b/README.md', 'second', 2), ('a/sub/Guide.MARKDOWN', 'third', 0)) AS t(file, text, input)")
def markdown_inputs(spark, d):
    """Two roots that hold a file of the same name, a root inside another, our own work folder, other suffixes."""
    top = _put(spark, "md", {"a/README.md": "first\r\nline", "b/README.md": "second", "a/sub/Guide.MARKDOWN": "third", "a/notes.txt": "no", "b/work/x.md": "no"})
    return files_.read_markdown(spark, [f"{top}/a", f"{top}/a/sub", f"{top}/b"], work_dir="work/").select("file", "text", "input")


@query("SELECT file FROM (VALUES ('src/A.java'), ('src/deep/B.JAVA'), ('src/m.xml'), ('one.txt')) AS t(file)")
def code_inputs(spark, d):
    top = _put(spark, "code", {"src/A.java": "a", "src/deep/B.JAVA": "b", "src/m.xml": "m", "src/target/C.java": "c", "src/deep/test/D.java": "d", "src/x.py": "x", "one.txt": "taken as it is named"})
    return files_.read_code(spark, [f"{top}/src", f"{top}/one.txt"]).select("file")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'docs/' || n_name || '.md' ELSE n_name || '.md' END AS inside, CASE WHEN n_nationkey % 3 = 0 THEN 'docs/' || n_name || '.md' WHEN n_nationkey % 3 = 1 THEN '/other/' || n_name || '.md' ELSE n_name || '.md' END AS whole FROM nation")
def relative_names(spark, d):
    k = F.col("n_nationkey") % 3
    path = F.concat(F.when(k == 0, "/work/docs/").when(k == 1, "/other/").otherwise("/work/"), "n_name", F.lit(".md"))
    return table(spark, d, "nation").select("n_nationkey", files_.relative_name(path, "/work", "name").alias("inside"), files_.relative_name(path, "/work").alias("whole"))


_VERDICTS = {
    "out/batch-001.json": '[{"item_id": "R-001", "verdict": "missing"}, {"item_id": " ", "verdict": "missing"}, {"item_id": "R-002", "verdict": "partial"}, 7]',
    "out/batch-002.json": '[{"item_id": "R-001", "verdict": "implemented", "evidence": [{"file": "a", "line": "x", "quote": "q"}]}, {"item_id": "R-002", "verdict": ""}]',
    "out/batch-003.json": "{not json",
    "out/recheck-001.json": '[{"item_id": "R-001", "second_verdict": "refuted"}, {"item_id": "R-001", "second_verdict": "confirmed", "reason": "r"}, {"item_id": "R-009", "second_verdict": null}]',
    "items/text-001.json": '[{"assertion": " one ", "kind": "existence"}, {"assertion": ""}, {"assertion": "two", "group": "g"}]',
    "items/text-002.json": '[{"assertion": "one", "kind": "behavior"}, {"assertion": "three"}]',
    "items/image-001.json": "[]",
}


@query("SELECT item_id, verdict, CAST(n_evidence AS INT) AS n_evidence FROM (VALUES ('R-001', 'implemented', 1), ('R-002', 'partial', 0)) AS t(item_id, verdict, n_evidence)")
def load_verdicts(spark, d):
    top = _put(spark, "verdicts", _VERDICTS)
    return results.load_verdicts(spark, f"{top}/out/batch-*.json").select("item_id", "verdict", F.size(F.coalesce("evidence", F.array().cast(S.EVIDENCE))).alias("n_evidence"))


@query("SELECT 'R-001' AS item_id, 'confirmed' AS second_verdict, 'r' AS reason")
def load_rechecks(spark, d):
    top = _put(spark, "rechecks", _VERDICTS)
    return results.load_rechecks(spark, f"{top}/out/recheck-*.json").select("item_id", "second_verdict", "reason")


@query("SELECT id, assertion, kind, \"group\" FROM (VALUES ('R-001', 'one', 'existence', NULL), ('R-002', 'two', NULL, 'g'), ('R-003', 'three', NULL, NULL)) AS t(id, assertion, kind, \"group\")")
def load_items(spark, d):
    top = _put(spark, "items", _VERDICTS)
    return results.load_items(spark, f"{top}/items").select("id", "assertion", "kind", "group")


@query("SELECT 2 AS n_text, 0 AS n_image")
def result_classes(spark, d):
    top = _put(spark, "classes", _VERDICTS)
    rows = files_.read_json_rows(spark, f"{top}/items", "assertion STRING")
    return results.counts_per_class(rows, ("text", "image"))


@query("SELECT region.r_regionkey, r_name, body FROM region, (SELECT string_agg(r_name, chr(10) ORDER BY r_regionkey) AS body FROM region)")
def write_read_back(spark, d):
    """Tables, JSON and a document, each written and read again."""
    r, top = table(spark, d, "region"), scratch_path(spark, "sinks")
    sinks.write_table(r, f"{top}/table", "r_regionkey")
    sinks.write_json(r, f"{top}/json")
    sinks.write_document(r.withColumn("text", F.col("r_name")), f"{top}/doc", ["r_regionkey"])
    names = spark.read.schema("r_regionkey INT, r_name STRING").json(f"{top}/json")
    body = spark.read.text(f"{top}/doc", wholetext=True).select(F.rtrim(F.col("value"), F.lit("\n")).alias("body"))
    return spark.read.parquet(f"{top}/table").select(F.col("r_regionkey").cast("int").alias("r_regionkey")).join(names, "r_regionkey").join(F.broadcast(body))


@query("SELECT n_nationkey % 5 AS batch, CASE WHEN n_nationkey % 5 < 3 THEN 'filled' ELSE 'blank' END AS state, count(*) AS n FROM nation GROUP BY 1, 2")
def blanks_never_overwritten(spark, d):
    n, at = table(spark, d, "nation").select(F.col("n_nationkey"), (F.col("n_nationkey") % 5).alias("batch")), scratch_path(spark, "blanks")
    sinks.write_blanks(n.where("batch < 3").withColumn("state", F.lit("filled")), at)
    sinks.write_blanks(n.withColumn("state", F.lit("blank")), at)
    return spark.read.parquet(at).groupBy("batch", "state").agg(F.count("*").alias("n"))


@query("SELECT stage, step, status FROM (VALUES ('extract', 'packs', 'done'), ('compare', 'index', 'running')) AS t(stage, step, status)")
def stage_notes(spark, d):
    at = scratch_path(spark, "work")
    for stage, step, state in (("extract", "blocks", "running"), ("extract", "packs", "done"), ("compare", "index", "running")):
        sinks.note_stage(spark, at, stage, step, state)
    return sinks.status(spark, at).select("stage", "step", "status")


# ---- the index

_CLASS = '/** Keeps orders {n}. */\n@RequestMapping("/orders{n}")\npublic class Order{n}Service {\n  private int size{n};\n  /** Saves one. */\n  @PostMapping("/save") public void save{n}(int x) {\n    throw new E(4102{m});\n  }\n}\n'
_MAPPER = '<mapper namespace="n{n}">\n<select id="find">x</select>\n</mapper>\n'


def _nation_files(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{n}"), n.cast("string")), F.lit("{m}"), (n % 10).cast("string"))
    rows = table(spark, d, "nation")
    java = rows.select(F.format_string("src/Order%dService.java", n).alias("file"), fill(_CLASS).alias("text"), n.cast("bigint").alias("mtime"))
    maps = rows.where("n_nationkey < 5").select(F.format_string("src/m%d.xml", n).alias("file"), fill(_MAPPER).alias("text"), n.cast("bigint").alias("mtime"))
    return java.union(maps).withColumn("size", F.length("text").cast("bigint"))


def _nation_symbols(spark: SparkSession, d: str) -> DataFrame:
    return index.symbols_of(_nation_files(spark, d))


@query("""
WITH s(step, reused) AS (VALUES ('1 first', false), ('2 again', true), ('3 changed', false), ('4 other digits', false), ('5 back', true)),
f(family, each) AS (VALUES ('types', 1), ('methods', 1), ('fields', 1), ('urls', 1), ('error_codes', 1))
SELECT step, reused, family, each * (SELECT count(*) FROM nation) AS n_symbols, CAST(5 AS BIGINT) AS n_statements FROM s, f WHERE NOT (step = '4 other digits' AND family = 'error_codes')""")
def index_cached(spark, d):
    """Built, found again, built anew for a changed file and for other settings, and found again."""
    files, at, out = _nation_files(spark, d), scratch_path(spark, "index"), None
    changed = files.withColumn("mtime", F.col("mtime") + F.when(F.col("file") == "src/Order0Service.java", 1).otherwise(0))
    steps = (("1 first", files, 5), ("2 again", files, 5), ("3 changed", changed, 5), ("4 other digits", files, 4), ("5 back", files, 5))
    for step, rows, digits in steps:
        folder, reused = index.cached_index(rows, at, EngineConfig(error_code_digits=digits))
        found, statements = index.load_index(spark, folder)
        total = statements.agg(F.count("*").alias("n_statements"))
        part = found.groupBy("family").agg(F.count("*").alias("n_symbols")).join(F.broadcast(total)).select(F.lit(step).alias("step"), F.lit(reused).alias("reused"), "family", "n_symbols", "n_statements")
        out = part if out is None else out.union(part)
    return out


@query("SELECT count(*) AS n_types, count(*) AS n_methods, count(*) AS n_urls, count(*) + 5 AS n_files FROM nation")
def index_counts(spark, d):
    return symbols.index_summary(_nation_symbols(spark, d), _nation_files(spark, d))


@query("""
WITH s AS (SELECT 'doc' || doc_id || ':' || n_chars || ':' || length(lang) AS s, left(sha1('doc' || doc_id), 4) AS bucket FROM documents),
b AS (SELECT bucket, sha1(string_agg(s, chr(10) ORDER BY s)) AS digest FROM s GROUP BY bucket)
SELECT sha1('digits=5' || chr(10) || string_agg(bucket || ':' || digest, chr(10) ORDER BY bucket)) AS fingerprint FROM b""")
def tree_fingerprint(spark, d):
    rows = table(spark, d, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("file"), F.col("n_chars").alias("mtime"), F.length("lang").alias("size"))
    return symbols.tree_fingerprint(rows)


@query("SELECT o_orderkey, CAST(1 + o_orderkey % 4 AS INT) AS digits, CAST(10 ** (o_orderkey % 4) AS BIGINT) + o_orderkey % (9 * CAST(10 ** (o_orderkey % 4) AS BIGINT)) AS code FROM orders")
def code_digits(spark, d):
    """Error codes of as many digits as the settings say."""
    k, out = F.col("o_orderkey"), None
    for digits in range(1, 5):
        low = 10 ** (digits - 1)
        said = table(spark, d, "orders").where(k % 4 == digits - 1).select("o_orderkey", (low + k % (9 * low)).alias("code"))
        text = F.concat(F.lit("code "), F.col("code").cast("string"), F.lit(", not x"), F.col("code").cast("string"))
        part = said.select("o_orderkey", F.lit(digits).alias("digits"), F.explode(F.transform(X.error_codes(text, digits), lambda x: x.cast("bigint"))).alias("code"))
        out = part if out is None else out.union(part)
    return out


_JAVA2 = '/** Outer {n}. */\nabstract class Outer{n} {\n  static { int ignored = 1; }\n  Map<String, List<Integer>> byName = new HashMap<>();\n  Runnable task = () -> { run(); };\n  Object anon = new Object() { public void hidden() { } };\n  Outer{n}(int x) { this.x = x; }\n  /** Makes. */\n  public <T> T make(T x) { return x; }\n  interface Inner { void ping(); }\n  enum State { READY, DONE }\n}\n'


@query("""
WITH s(family, name, line, doc) AS (VALUES ('types', 'Outer{n}', 2, 'Outer {n}.'), ('types', 'Inner', 10, ''), ('types', 'State', 11, ''), ('methods', 'make', 9, 'Makes.'), ('methods', 'Outer{n}', 7, ''),
  ('methods', 'ping', 10, ''), ('fields', 'byName', 4, ''), ('fields', 'task', 5, ''), ('fields', 'anon', 6, ''))
SELECT n_nationkey, family, replace(name, '{n}', CAST(n_nationkey AS VARCHAR)) AS name, line, replace(doc, '{n}', CAST(n_nationkey AS VARCHAR)) AS doc FROM nation, s""")
def java_shapes(spark, d):
    """Initialisers, lambdas, anonymous classes, constructors, generics, nested types and an enum without a semicolon."""
    n = F.col("n_nationkey")
    files = table(spark, d, "nation").select(F.format_string("F%d.java", n).alias("file"), F.replace(F.lit(_JAVA2), F.lit("{n}"), n.cast("string")).alias("text"))
    out = symbols.java_symbols(files).where("family IN ('types', 'methods', 'fields', 'enum_constants') AND name NOT LIKE 'hidden'")
    return out.select(F.regexp_extract("file", r"(\d+)", 1).cast("int").alias("n_nationkey"), "family", "name", "line", F.trim(F.coalesce("doc", F.lit(""))).alias("doc"))


# ---- blocks and packs

_MD2 = "intro {n}\n\n```sql\n# not a heading\n\n| a |\n```\n\n> quoted\n\n> still quoted\n\n1. one\n\n  deeper\n2) two\n"


@query("""
WITH b(start_line, end_line, kind) AS (VALUES (1, 1, 'para'), (3, 7, 'code'), (9, 11, 'quote'), (13, 16, 'list')) SELECT n_nationkey, start_line, end_line, kind FROM nation, b""")
def md_shapes(spark, d):
    """Fences that hold other marks, quotes and lists over one blank line."""
    n = F.col("n_nationkey")
    files = table(spark, d, "nation").select(F.format_string("%d.md", n).alias("file"), F.replace(F.lit(_MD2), F.lit("{n}"), n.cast("string")).alias("text"))
    return B.split_blocks(files).select(F.regexp_extract("file", r"(\d+)", 1).cast("int").alias("n_nationkey"), "start_line", "end_line", "kind")


@query("WITH b(start_line, end_line) AS (VALUES (3, 27), (29, 68), (69, 79)) SELECT r_regionkey, start_line, end_line FROM region, b")
def md_long_blocks(spark, d):
    """A fence of 77 lines: cut at its blank line, then after 40 lines."""
    k = F.col("r_regionkey").cast("string")
    text = F.lit("t\n\n```\n" + "\n".join(["x"] * 24) + "\n\n" + "\n".join(["y"] * 50) + "\n```")
    out = B.split_blocks(table(spark, d, "region").select(k.alias("file"), text.alias("text")))
    return out.where("kind = 'code'").select(F.col("file").cast("int").alias("r_regionkey"), "start_line", "end_line")


_BLOCKS_SQL = """bl AS (SELECT p_partkey AS block_ord, printf('B%04d', p_partkey) AS id, 'f' || printf('%04d', p_partkey // 100) AS file, CASE p_partkey % 5 WHEN 0 THEN 'heading' ELSE 'para' END AS kind,
  CASE WHEN p_partkey % 7 = 0 THEN ['A', '业务规则'] ELSE ['A', p_brand] END AS heading, p_name || repeat(chr(10) || 'more', CAST(p_size AS INT)) AS text, CASE WHEN p_partkey % 11 = 0 THEN [p_brand] ELSE [] END AS images, p_size FROM part)"""


def _part_blocks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    heading = F.when(k % 7 == 0, F.array(F.lit("A"), F.lit("业务规则"))).otherwise(F.array(F.lit("A"), F.col("p_brand")))
    text = F.concat("p_name", F.repeat(F.lit("\nmore"), F.col("p_size").cast("int")))
    images = F.when(k % 11 == 0, F.array("p_brand")).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select(
        big(k).alias("block_ord"), F.format_string("B%04d", k).alias("id"), F.format_string("f%04d", F.floor(k / 100)).alias("file"), F.lit(1).alias("start_line"), (1 + F.col("p_size")).cast("int").alias("end_line"),
        F.when(k % 5 == 0, "heading").otherwise("para").alias("kind"), heading.alias("heading"), text.alias("text"), images.alias("images"),
    )


@query(f"WITH {_BLOCKS_SQL} SELECT id, CASE WHEN len(images) > 0 THEN 'image' ELSE 'text' END AS route FROM bl WHERE len(images) > 0 OR kind <> 'heading'")
def block_routes(spark, d):
    return packs.routed(_part_blocks(spark, d)).select("id", "route")


@query(f"""WITH {_BLOCKS_SQL}, c AS (SELECT id, sum(p_size + 3) OVER (ORDER BY block_ord) AS run FROM bl WHERE len(images) = 0 AND kind <> 'heading' AND array_to_string(heading, ' ') LIKE '%业务规则%')
SELECT id FROM c WHERE run <= 320""")
def base_context(spark, d):
    return packs.base_context(_part_blocks(spark, d)).select("id")


_GREEDY = """
r AS (SELECT file, block_ord AS o, p_size + 14 AS c, len(images) > 0 AS image, row_number() OVER (PARTITION BY file, len(images) > 0 ORDER BY block_ord) AS rn FROM bl WHERE len(images) > 0 OR kind <> 'heading'),
f AS (SELECT file, image, o, rn, c AS cost, 1 AS n, 0 AS batch FROM r WHERE rn = 1
  UNION ALL SELECT file, image, o, rn, CASE WHEN new THEN c ELSE cost + c END, CASE WHEN new THEN 1 ELSE n + 1 END, batch + CASE WHEN new THEN 1 ELSE 0 END FROM (
    SELECT r.*, f.cost, f.n, f.batch, CASE WHEN r.image THEN f.n >= 6 ELSE f.cost + r.c > 1200 OR f.n >= 60 END AS new FROM f JOIN r ON r.file = f.file AND r.image = f.image AND r.rn = f.rn + 1))"""


@query(f"""WITH RECURSIVE {_BLOCKS_SQL}, {_GREEDY}
SELECT o AS block_ord, printf('%s-%03d', CASE WHEN image THEN 'image' ELSE 'text' END, dense_rank() OVER (PARTITION BY image ORDER BY file, batch)) AS pack FROM f""")
def block_packs(spark, d):
    return packs.block_batches(_part_blocks(spark, d)).select("block_ord", "pack")


_HEAD = f"chr(10) || chr(10) || '{render.ITEM_RULES}' || chr(10) || chr(10) || '## Background' || chr(10) || chr(10) || rule || chr(10) || chr(10) || '## Blocks' || chr(10) || chr(10)"


@query(f"""
WITH r AS (SELECT '[B0002] one.md:2-2 (A / 业务规则)' || chr(10) || 'rule ' || count(*) AS rule FROM region)
SELECT 'text-001' AS pack, '# text-001' || {_HEAD} || rule AS text FROM r
UNION ALL SELECT 'image-001', '# image-001' || {_HEAD} || '[B0003] one.md:3-3 (A)' || chr(10) || '![x](p.png)' || chr(10) || 'images: p.png' FROM r""")
def extraction_pack_texts(spark, d):
    n = table(spark, d, "region").agg(F.concat(F.lit("rule "), F.count("*").cast("string")).alias("said"))
    made = F.array(*[F.struct(F.lit(i).cast("bigint").alias("block_ord"), F.lit(f"B{i:04d}").alias("id"), F.lit("one.md").alias("file"), F.lit(i).alias("start_line"), F.lit(i).alias("end_line"), F.array(*map(F.lit, path)).alias("heading"), F.lit(kind).alias("kind"), text.alias("text"), F.array(*map(F.lit, images)).cast("array<string>").alias("images")) for i, path, kind, text, images in ((1, ("A",), "heading", F.lit("# A"), ()), (2, ("A", "业务规则"), "para", F.col("said"), ()), (3, ("A",), "para", F.lit("![x](p.png)"), ("p.png",)))])
    return packs.extraction_packs(n.select(F.inline(made)))


@query(f"WITH {_BLOCKS_SQL}, t AS (SELECT *, replace(text, chr(10), ' ') AS flat FROM bl) SELECT block_ord, '| ' || id || ' | ' || file || ' | 1-' || (1 + p_size) || ' | ' || array_to_string(heading, ' / ') || ' | ' || kind || ' | ' || CASE WHEN length(flat) > 60 THEN left(flat, 60) || '…' ELSE flat END || ' |' AS \"row\" FROM t")
def block_listing(spark, d):
    return packs.block_listing(_part_blocks(spark, d))


# ---- checks, misses and logs


def _supplier_code(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(F.lit("types").alias("family"), k.alias("sym_ord"), F.concat(F.lit("K"), (k % 45).cast("string"), F.lit("Service")).alias("name"), F.concat(F.lit("f"), (k % 9).cast("string")).alias("file"), (k % 3).cast("int").alias("line"), F.lit("o").alias("owner"), _none().alias("handler"))


def _part_items(spark: SparkSession, d: str) -> DataFrame:
    name = lambda n: F.concat(F.lit("K"), n.cast("string"), F.lit("Service"))
    size = F.col("p_size")
    said = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" and ", name(size), name(size + 40))).otherwise(name(size))
    return table(spark, d, "part").select(big("p_partkey").alias("item_id"), F.when(F.col("p_partkey") % 5 == 0, "behavior").otherwise("existence").alias("kind"), X.identifiers(said).alias("ids"))


_SITES_SQL = """
i AS (SELECT p_partkey AS item_id, p_partkey % 5 = 0 AS behavior, CASE WHEN p_partkey % 3 = 0 THEN ['K' || p_size || 'Service', 'K' || (p_size + 40) || 'Service'] ELSE ['K' || p_size || 'Service'] END AS ids FROM part),
s AS (SELECT 'K' || (s_suppkey % 45) || 'Service' AS name, s_suppkey AS o, 'f' || (s_suppkey % 9) AS file, s_suppkey % 3 AS line FROM supplier),
c AS (SELECT item_id, behavior, unnest(range(0, len(ids))) AS co, unnest(ids) AS target FROM i)"""


@query(f"""WITH {_SITES_SQL}, h AS (SELECT item_id, behavior, co, o, file, line, row_number() OVER (PARTITION BY item_id, file, line ORDER BY co, o) AS n FROM c JOIN s ON s.name = c.target),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY co, o) AS r FROM h WHERE n = 1)
SELECT item_id, string_agg(file || ':' || line, ',' ORDER BY r) AS places FROM k WHERE r <= CASE WHEN behavior THEN 8 ELSE 10 END GROUP BY item_id""")
def hit_evidence(spark, d):
    items = _part_items(spark, d)
    found = lookup.flatten_hits(lookup.run_checks(lookup.checks(items), _supplier_code(spark, d)))
    return found.select("item_id", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["file"], e["line"].cast("string"))), ",").alias("places"))


@query(f"""WITH {_SITES_SQL}, n AS (SELECT name, min(o) AS o FROM s GROUP BY name),
m AS (SELECT item_id, co, target FROM c WHERE target NOT IN (SELECT name FROM n)),
near AS (SELECT target, n.name, row_number() OVER (PARTITION BY target ORDER BY n.o, n.name) AS r FROM (SELECT DISTINCT target FROM m) t JOIN n ON (contains(lower(n.name), lower(target)) OR contains(lower(target), lower(n.name))) AND lower(n.name) <> lower(target)),
l AS (SELECT target, string_agg(name, ',' ORDER BY r) AS nearest FROM near WHERE r <= 3 GROUP BY target)
SELECT m.item_id, m.target, coalesce(l.nearest, '') AS nearest FROM m LEFT JOIN l ON l.target = m.target""")
def nearest_on_miss(spark, d):
    checked = lookup.nearest_on_miss(lookup.run_checks(lookup.checks(_part_items(spark, d)), _supplier_code(spark, d)), _supplier_code(spark, d))
    return checked.where("n_hits = 0").select("item_id", "target", F.array_join(F.transform("nearest", lambda n: n["name"]), ",").alias("nearest"))


@query(f"""WITH {_SITES_SQL}, h AS (SELECT item_id, co, target, behavior, exists(SELECT 1 FROM s WHERE s.name = c.target) AS hit FROM c)
SELECT item_id, CASE WHEN bool_or(behavior) OR bool_and(hit) THEN '' ELSE 'not found: ' || string_agg(target, ', ' ORDER BY co) FILTER (NOT hit) END AS reason FROM h GROUP BY item_id""")
def static_reason(spark, d):
    items = _part_items(spark, d)
    return lookup.static_verdicts(items, lookup.run_checks(lookup.checks(items), _supplier_code(spark, d))).select("item_id", "reason")


@query("""SELECT p_partkey AS item_id, 'src,lib' AS scope, (SELECT count(*) FROM supplier) AS file_count, 'K' || p_size || 'Service' || CASE WHEN p_partkey % 3 = 0 THEN ',K' || (p_size + 40) || 'Service' ELSE '' END AS keywords FROM part""")
def search_log(spark, d):
    n = table(spark, d, "supplier").agg(F.count("*").alias("n_files"))
    rows = lookup.search_log(_part_items(spark, d).join(F.broadcast(n)), ["src", "lib"], F.col("n_files"))
    return rows.select("item_id", F.array_join("search_log.scope", ",").alias("scope"), "search_log.file_count", F.array_join("search_log.keywords", ",").alias("keywords"))


# ---- recall


@query("SELECT o_orderkey, o_custkey % 200 AS handler, s_suppkey AS m_ord FROM orders JOIN supplier ON s_suppkey % 200 = o_custkey % 200")
def follow_handlers(spark, d):
    hits = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("handler"))
    methods = table(spark, d, "supplier").select((F.col("s_suppkey") % 200).alias("name"), F.lit("f").alias("file"), F.lit(1).alias("line"), F.col("s_suppkey").alias("sym_ord"))
    return context.follow_handlers(hits, methods).select("o_orderkey", "handler", "m_ord")


@query("""
WITH own AS (SELECT o_custkey AS batch, o_orderpriority AS file, min(o_orderkey) AS o FROM orders GROUP BY 1, 2),
a AS (SELECT batch, file, row_number() OVER (PARTITION BY batch ORDER BY o, file) AS r FROM own), k AS (SELECT * FROM a WHERE r <= 3),
n AS (SELECT c_custkey AS batch, c_mktsegment || v AS file, v AS rank FROM customer, (VALUES (1), (2), (3), (4)) AS t(v)),
h AS (SELECT batch, count(*) AS have FROM k GROUP BY batch)
SELECT batch, file, file_rank FROM (SELECT n.batch, n.file, rank + coalesce(have, 0) AS file_rank FROM n LEFT JOIN h USING (batch)) WHERE file_rank <= 5""")
def recall_top_up(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    own = context.anchor_files(o.select(F.col("o_custkey").alias("batch"), F.col("o_orderpriority").alias("file"), F.lit(1).alias("line"), "o_orderkey"), "batch", "file", "line", "o_orderkey", 3)
    ranked = c.select(F.col("c_custkey").alias("batch"), "c_mktsegment", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("rank")).select("batch", F.concat("c_mktsegment", F.col("rank").cast("string")).alias("file"), "rank")
    return context.top_up(own, ranked, "batch", "file").select("batch", "file", big("file_rank").alias("file_rank"))


@query("""SELECT n_nationkey, 'Order' || n_nationkey || 'Service' AS name, 1 AS rank FROM nation""")
def bm25_symbols(spark, d):
    """The class whose documentation a question reads like, of an index of documented classes and methods."""
    asked = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("keeps order"), F.col("n_nationkey").cast("string"), F.lit("_x Order"), F.col("n_nationkey").cast("string"), F.lit("Service")).alias("asked"))
    out = retrieval.symbol_bm25(asked, _nation_symbols(spark, d), "n_nationkey", "asked", 1)
    return out.select(F.col("query_id").alias("n_nationkey"), "name", F.col("rank").cast("int").alias("rank"))


@query("""
WITH s AS (SELECT DISTINCT o_custkey % 50 AS file, CAST(o_orderkey % 20 AS INT) AS s FROM orders), w AS (SELECT DISTINCT c_custkey % 50 AS file, CAST(c_custkey % 20 AS INT) AS s FROM customer)
SELECT file, s AS start, s + 5 AS "end" FROM s WHERE (file, s) NOT IN (SELECT (file, s) FROM w)""")
def shared_snippets(spark, d):
    span = lambda t, f, s: table(spark, d, t).select((F.col(f) % 50).alias("file"), (F.col(s) % 20).cast("int").alias("start"), (F.col(s) % 20 + 5).cast("int").alias("end"))
    return context.shared_snippets(span("orders", "o_custkey", "o_orderkey"), span("customer", "c_custkey", "c_custkey")).select("file", "start", "end")


@query("""
WITH e AS (SELECT l_orderkey AS k, CAST(l_linenumber AS INT) AS n, 'f' || (l_partkey % 3) || ':' || (l_linenumber % 3) AS p FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity) AS z FROM lineitem) WHERE z = 1),
u AS (SELECT k, p, min(n) AS n FROM e GROUP BY k, p), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS r FROM u)
SELECT k AS l_orderkey, string_agg(p, ',' ORDER BY r) AS places FROM r WHERE r <= 5 GROUP BY k""")
def first_positions(spark, d):
    one = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min_by("l_partkey", F.struct("l_partkey", "l_quantity")).alias("p"))
    lists = one.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("f"), (F.col("p") % 3).cast("string")).alias("file"), (F.col("l_linenumber") % 3).cast("int").alias("line")))).alias("e"))
    return lists.select("l_orderkey", F.array_join(context.first_positions(F.col("e")), ",").alias("places"))


@query("SELECT doc_id, CAST(len(string_split(left(text, CAST(doc_id % 300 AS BIGINT)), chr(10))) AS INT) AS line FROM documents")
def line_of(spark, d):
    return table(spark, d, "documents").select("doc_id", X.line_of(F.col("text"), (F.col("doc_id") % 300).cast("int")).alias("line"))


@query("SELECT p_partkey, CASE WHEN length(s) > 30 THEN left(s, 30) || '…' ELSE s END AS clipped FROM (SELECT p_partkey, p_name || ' ' || p_type AS s FROM part)")
def clip_text(spark, d):
    return table(spark, d, "part").select("p_partkey", X.clip(F.concat_ws(" ", "p_name", "p_type"), 30).alias("clipped"))


# ---- second review


@query("SELECT o_orderkey AS item_id, coalesce(c_mktsegment, '') AS text, coalesce(c_name, '') AS note FROM orders LEFT JOIN customer ON c_custkey = o_orderkey")
def enrich_claims(spark, d):
    items = table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"), F.col("c_mktsegment").alias("text"), F.col("c_name").alias("note"))
    return verdict.enrich_claims(table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id")), items).select("item_id", "text", "note")


@query("""
WITH e AS (SELECT doc_id, unnest(range(0, 3)) AS n FROM documents),
p AS (SELECT doc_id, n, CASE WHEN (doc_id + n) % 4 = 0 THEN 'no_file' WHEN (doc_id + n) % 4 = 1 THEN 'no_such_file' WHEN (doc_id + n) % 4 = 2 THEN 'empty_quote' END AS problem FROM e)
SELECT doc_id, string_agg(problem, ',' ORDER BY n) AS problems FROM p GROUP BY doc_id""")
def evidence_problem_lists(spark, d):
    docs = table(spark, d, "documents")
    kind = lambda n: (F.col("doc_id") + n) % 4
    one = lambda n: F.struct(F.when(kind(n) == 0, "").when(kind(n) == 1, "none").otherwise(F.col("doc_id").cast("string")).alias("file"), F.lit("1").alias("line"), F.when(kind(n) == 2, " ").when(kind(n) == 3, F.regexp_extract("text", r"(\S+)", 1)).otherwise("q").alias("quote"))
    claims = docs.where("text rlike '[^ \\n]'").select("doc_id", F.array(*[one(n) for n in range(3)]).alias("evidence"))
    found = verdict.problems_of(verdict.verify_evidence(claims, docs.select(F.col("doc_id").cast("string").alias("file"), "text"), ["doc_id"]), ["doc_id"])
    blank = docs.where("NOT coalesce(text rlike '[^ \\n]', false)").select("doc_id", F.array(*[F.when(kind(n) == 0, "no_file").when(kind(n) == 1, "no_such_file").when(kind(n) == 2, "empty_quote") for n in range(3)]).alias("problems"))
    rows = found.select("doc_id", "problems").union(blank.select("doc_id", F.array_compact("problems")))
    return rows.select("doc_id", F.when(F.size("problems") > 0, F.array_join("problems", ",")).alias("problems"))


_SECOND_SQL = """
r AS (SELECT n_nationkey AS k, CASE n_nationkey % 6 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'refuted' WHEN 2 THEN 'unverifiable' WHEN 3 THEN 'bogus' ELSE 'confirmed' END AS said,
  n_nationkey % 6 <> 4 AS in_window, n_nationkey % 5 <> 0 AS clause_in, n_nationkey % 7 <> 3 AS numeric FROM nation)"""


@query(f"""WITH {_SECOND_SQL}
SELECT k AS item_id, CASE WHEN said = 'bogus' THEN 'unverifiable' WHEN said = 'unverifiable' THEN said WHEN NOT in_window OR NOT numeric THEN 'unverifiable' WHEN said = 'confirmed' AND NOT clause_in THEN 'unverifiable' ELSE said END AS second FROM r""")
def recheck_evidence(spark, d):
    """Second verdicts whose evidence lies outside the code shown, has no line number, or leaves a clause without any."""
    k = F.col("n_nationkey")
    rows, line = table(spark, d, "nation"), F.lit("line {n} of code")
    files = rows.select(F.format_string("f%d", k).alias("file"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n").alias("text"))
    windows = rows.select(big(k).alias("item_id"), F.format_string("f%d", k).alias("file"), F.lit(10).alias("start"), F.lit(20).alias("end"))
    at = lambda n: F.array(F.struct(F.format_string("f%d", k).alias("file"), n.cast("string").alias("line"), F.concat(F.lit("line "), F.when(n.cast("string") == "x", "1").otherwise(n.cast("string"))).alias("quote")))
    own = F.when(k % 7 == 3, F.lit("x")).when(k % 6 == 4, F.lit("40")).otherwise(F.lit("12"))
    clause = F.when(k % 5 == 0, F.lit("30")).otherwise(F.lit("15"))
    said = F.when(k % 6 == 1, "refuted").when(k % 6 == 2, "unverifiable").when(k % 6 == 3, "bogus").otherwise("confirmed")
    both = F.array(F.struct(F.lit("one").alias("text"), at(F.lit("11")).alias("evidence")), F.struct(F.lit("two").alias("text"), F.concat(at(F.lit("50")), at(clause)).alias("evidence")))
    rechecks = rows.select(big(k).alias("item_id"), said.alias("second_verdict"), at(own).alias("evidence"), both.alias("clauses"))
    return verdict.effective_seconds(rechecks, files, windows)


# ---- reports


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'f' || p_size || ':' || (p_size % 9) END AS position, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS quote, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand || ' g:' || p_size END AS nearest FROM part""")
def first_of_lists(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size").cast("int")
    evidence = F.array(F.struct(F.lit("").alias("file"), F.lit(0).alias("line"), F.lit(None).cast("string").alias("quote")), F.struct(F.when(k % 3 == 0, _none()).otherwise(F.concat(F.lit("f"), size.cast("string"))).alias("file"), (size % 9).alias("line"), F.when(k % 4 == 0, "").otherwise(F.col("p_name")).alias("quote")))
    nearest = F.when(k % 5 == 0, F.array().cast("array<struct<name:string,file:string,line:int>>")).otherwise(F.array(F.struct(F.col("p_brand").alias("name"), F.lit("g").alias("file"), size.alias("line"))))
    rows = table(spark, d, "part").select("p_partkey", evidence.alias("e"), nearest.alias("n"))
    return rows.select("p_partkey", render.first_position(F.col("e")).alias("position"), render.first_quote(F.col("e")).alias("quote"), render.first_nearest(F.col("n")).alias("nearest"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'said' ELSE array_to_string(list_slice(string_split(text, chr(10)), 1 + doc_id % 4, 4 + doc_id % 4), chr(10)) END AS snippet,
  CASE WHEN doc_id % 3 = 0 THEN 'said' ELSE array_to_string(list_slice(string_split(text, chr(10)), greatest(1, doc_id % 4), greatest(1, doc_id % 4) + 3), chr(10)) END AS earlier FROM documents WHERE text IS NOT NULL""")
def evidence_snippets(spark, d):
    i = F.col("doc_id")
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    evidence = F.array(F.struct(i.cast("string").alias("file"), (1 + i % 4).cast("string").alias("line"), F.when(i % 3 == 0, "said").alias("quote")))
    out = render.with_snippets(docs.select("doc_id", evidence.alias("evidence")), docs.select(i.cast("string").alias("file"), "text"))
    return out.select("doc_id", "snippet", F.col("earlier_snippet").alias("earlier"))


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'found by script' WHEN 1 THEN 'not reviewed yet' WHEN 2 THEN 'reviewed, quotes verified' WHEN 3 THEN 'reviewed, quotes do not match' ELSE 'second review: refuted' END AS label FROM nation")
def review_labels(spark, d):
    by = F.element_at(F.array(*map(F.lit, (S.BY_SCRIPT, S.BY_PENDING, S.BY_AI, S.BY_BOUNCED, S.BY_RECHECK + ":refuted"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", render.label(by).alias("label"))


# ---- the verbs, end to end


def _story(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(items, symbols, files, verdicts): five items for each nation. An endpoint that is there, a class that is not, and
    three that a reviewer judged: with a true quote, with a false one, and not yet."""
    files = _nation_files(spark, d).select("file", "text")
    n = F.col("n_nationkey")
    item = lambda i, kind, text: F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), F.replace(F.lit(text), F.lit("{n}"), n.cast("string")).alias("assertion"))
    made = F.array(item(1, "existence", "POST /orders{n}/save is there"), item(2, "existence", "Lost{n}Service is there"), item(3, "behavior", "orders {n} are saved"), item(4, "behavior", "orders {n} are checked"), item(5, "behavior", "orders {n} are sent"))
    rows = table(spark, d, "nation").select("n_nationkey", F.inline(made))
    order = big(n * 5 + F.col("i"))
    items = rows.select(F.format_string("R-%03d", order).alias("item_id"), order.alias("item_ord"), F.format_string("g%02d", n).alias("group"), "kind", "assertion", F.struct(F.lit("prd.md").alias("file"), F.lit(1).alias("line")).alias("source"), F.lit("").alias("text"), _none().alias("note"))
    quote = F.when(F.col("i") == 3, F.concat(F.lit("public class Order"), n.cast("string"), F.lit("Service {"))).otherwise("no such line")
    evidence = F.array(F.struct(F.format_string("src/Order%dService.java", n).alias("file"), F.lit("3").alias("line"), quote.alias("quote")))
    verdicts = rows.where("i IN (3, 4)").select(F.format_string("R-%03d", order).alias("item_id"), F.lit("implemented").alias("verdict"), evidence.alias("evidence"), F.lit("seen").alias("reason"), F.array().cast("array<string>").alias("missing"))
    code = index.build_index(_nation_files(spark, d), scratch_path(spark, "story"))
    return items, index.load_index(spark, code)[0], files, verdicts


def _compared(spark: SparkSession, items: DataFrame, code: DataFrame, files: DataFrame) -> verbs.Comparison:
    return verbs.compare(items, code, files, ["src"], kept=verbs.kept_below(scratch_path(spark, "compare")))


def _merged_story(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(items, symbols, files, merged), written and read again."""
    items, code, files, verdicts = _story(spark, d)
    merged, at = verbs.merge(items, _compared(spark, items, code, files), verdicts, files), scratch_path(spark, "merged")
    sinks.write_table(merged, at)
    return items, code, files, spark.read.parquet(at)


_FIVE = "(VALUES (1, 'implemented', 'script', 'ok'), (2, 'missing', 'script', 'fix'), (3, 'implemented', 'ai_verified', 'ok'), (4, 'undecidable', 'ai_bounced', 'confirm'), (5, 'undecidable', 'pending', 'confirm')) AS v(i, verdict, checked_by, placement)"


@query(f"SELECT printf('R-%03d', n_nationkey * 5 + i) AS item_id, verdict, checked_by, placement FROM nation, {_FIVE}")
def end_to_end(spark, d):
    """From items, code and a reviewer's verdicts to placed records."""
    items, code, files, merged = _merged_story(spark, d)
    none = spark.createDataFrame([], S.schema(S.RECHECKS))
    out = verbs.report(items, merged, none, spark.createDataFrame([], S.schema(S.WINDOWS)), code, files)
    return out.records.select("item_id", "verdict", "checked_by", "placement")


@query("SELECT printf('batch-%03d', n_nationkey + 1) AS name, CAST(3 AS BIGINT) AS n_items, true AS shows_code FROM nation")
def compare_packs(spark, d):
    """A pack for each group's items that a reviewer must judge, with code, and a blank that fits it."""
    items, code, files, _ = _story(spark, d)
    out = _compared(spark, items, code, files)
    blanks = out.blanks.select("batch", F.size(F.from_json("json", f"ARRAY<STRUCT<item_id:STRING,verdict:STRING,evidence:{S.EVIDENCE}>>")).cast("bigint").alias("n_items"))
    return out.packs.join(blanks, "batch").select("name", "n_items", F.col("text").contains("## Code").alias("shows_code"))


@query("SELECT printf('R-%03d', n_nationkey * 5 + 3) AS item_id, 'src/Order' || n_nationkey || 'Service.java' AS file, true AS own_class FROM nation")
def verify_packs(spark, d):
    """Windows of the claims that a second review gets, each with its own class."""
    items, code, files, merged = _merged_story(spark, d)
    out = verbs.verify(items, merged, code, files, kept=verbs.kept_below(scratch_path(spark, "verify")))
    own = out.windows.join(items.select("item_id", F.regexp_extract("group", r"(\d+)", 1).cast("int").alias("n")), "item_id").where(F.col("file") == F.format_string("src/Order%dService.java", "n"))
    packed = out.claims.select("item_id", "batch").join(out.packs, "batch").select("item_id", F.col("text").contains(F.concat(F.lit("### "), F.col("item_id"))).alias("own_class"))
    return own.join(packed, "item_id").select("item_id", "file", "own_class").distinct()


@query("""
WITH n AS (SELECT count(*) AS n FROM nation)
SELECT report, heading, CASE heading WHEN '## 1. Not done' THEN n WHEN '## 2. Sample of what was found in order' THEN 20 WHEN '## 3. Limits' THEN 3 WHEN '## 1. To be confirmed' THEN 2 * n END AS n_rows
FROM n, (VALUES ('fix', '## 1. Not done'), ('fix', '## 2. Sample of what was found in order'), ('fix', '## 3. Limits'), ('confirm', '## 1. To be confirmed')) AS h(report, heading)""")
def report_sections(spark, d):
    """Both reports: their sections in order and how many entries each has."""
    items, code, files, merged = _merged_story(spark, d)
    out = verbs.report(items, merged, spark.createDataFrame([], S.schema(S.RECHECKS)), spark.createDataFrame([], S.schema(S.WINDOWS)), code, files)
    rows = out.lines.select("report", "ord.section", "ord.head", "text")
    heads = rows.where("head = 0").select("report", "section", F.col("text").alias("heading"))
    return heads.join(rows.where("head = 1").groupBy("report", "section").agg(F.count("*").alias("n_rows")), ["report", "section"]).select("report", "heading", "n_rows")


@query("SELECT path, 'Order' || k || 'Service' AS owner, 'save' || k AS handler FROM (SELECT n_nationkey AS k, '/orders' || n_nationkey || '/save' AS path FROM nation) WHERE k % 2 = 1 AND k % 10 <> 1")
def report_extras(spark, d):
    """Endpoints that no item mentions: odd ones, unless a text names their handler."""
    items, code, _, _ = _story(spark, d)
    even = items.where("item_ord % 5 = 1").withColumn("n", ((F.col("item_ord") - 1) / 5).cast("int"))
    said = even.withColumn("assertion", F.when(F.col("n") % 2 == 0, F.col("assertion")).when(F.col("n") % 10 == 1, F.concat(F.lit("call save"), F.col("n").cast("string"))).otherwise("none")).drop("n")
    return verbs.unasked(said, code).select("path", "owner", "handler")
