from pyspark.sql import functions as F

from veritrace.config import EngineConfig
from veritrace.functions import text as X
from veritrace.operators import context, coverage, lookup, ordering, retrieval, verdict


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_identifiers(spark):
    text = "错误码41026 见 41027，接口 POST /refund/apply/{id} 与 `createOrder(dto)`、`orderNo`; RefundService.submit if (x) STATE_OK 4102"
    ids = one(spark, X.identifiers(F.lit(text)))
    assert [u["path"] for u in ids["urls"]] == ["/refund/apply/{id}"] and ids["urls"][0]["http"] == "POST"
    assert ids["types"] == ["RefundService"] and ids["methods"] == ["createOrder", "submit"] and ids["fields"] == ["orderNo"]
    assert ids["enum_values"] == ["STATE_OK"] and ids["error_codes"] == []
    assert one(spark, X.error_codes(F.lit("错误码41026 见 41027, 4102"))) == ["41027"]
    assert one(spark, X.error_codes(F.lit("a 4102 b"), 4)) == ["4102"]
    assert one(spark, X.identifiers(F.lit(None).cast("string")))["urls"] == []


def test_paths(spark):
    assert one(spark, X.norm_url(F.lit(" a//b/{id}/?q=1 "))) == "/a/b/{}"
    assert [one(spark, X.join_path(F.lit(b), F.lit(s))) for b, s in (("", ""), ("", "x"), ("y", ""), ("/a/", "/b"))] == ["/", "/x", "/y", "/a/b"]
    assert [one(spark, context.resolved_within(F.lit(p))) for p in ("a/./b/../c", "../x", "/etc", "a/../../b")] == ["a/c", None, None, None]


def test_quote_tiers(spark):
    window = "int a = 1;\n  return  a;\n}"
    tier = lambda q: one(spark, verdict.quote_tier(F.lit(q), F.lit(window)))
    assert [tier(q) for q in ("int a = 1;", "int a = 1; return a;", "}\nint a = 1;", "}\nmade up")] == [1, 2, 3, 0]


def test_evidence(spark):
    rows = spark.createDataFrame([("a", [("f", "1", "two")]), ("b", []), ("c", [("../f", "1", "x")]), ("d", [("f", "9", "x")]), ("e", [("f", "n", "one")]), ("g", [("f", "1", " ")])], "item_id STRING, evidence ARRAY<STRUCT<file:STRING,line:STRING,quote:STRING>>")
    files = spark.createDataFrame([("f", "one\ntwo")], "file STRING, text STRING")
    found = {r["item_id"]: r["problem"] for r in verdict.verify_evidence(rows, files, ["item_id"]).collect()}
    assert found == {"a": "ok", "b": "no_evidence", "c": "outside", "d": "bad_line", "e": "ok", "g": "empty_quote"}


def test_placement(spark):
    place = lambda v, by, ev, **k: one(spark, verdict.placement(F.lit(v), F.lit(by), F.lit(ev), config=EngineConfig(**k)))
    assert [place("implemented", "ai_verified", True), place("missing", "script", False), place("missing", "ai_verified", False), place("missing", "ai_verified", True), place("deviated", "ai_bounced", True)] == ["ok", "fix", "confirm", "fix", "confirm"]
    assert place("missing", "ai_verified", True, strict_missing=True) == "confirm"


def test_rechecks_change_nothing_without_rows(spark):
    merged = spark.createDataFrame([("a", "ai", "implemented", "ai_verified", True)], "item_id STRING, route STRING, verdict STRING, checked_by STRING, has_evidence BOOLEAN")
    none = spark.createDataFrame([], "item_id STRING, second STRING")
    row = verdict.apply_rechecks(merged, none).first()
    assert row["forced_placement"] is None and row["checked_by"] == "ai_verified"
    other = spark.createDataFrame([("z", "confirmed")], "item_id STRING, second STRING")
    assert verdict.apply_rechecks(merged, other).first()["forced_placement"] == "confirm"


def test_verbs(spark):
    urls = spark.createDataFrame([("POST /a/b",)], "key STRING")
    wanted = spark.createDataFrame([("/a/b/", "ANY"), ("/a/b", "GET"), ("/a/b", "POST")], "path STRING, http STRING")
    assert {(r["http"], r["key"]) for r in lookup.url_lookup(wanted, urls).collect()} == {("ANY", "POST /a/b"), ("GET", None), ("POST", "POST /a/b")}


def test_numbers_do_not_depend_on_partitions(spark):
    rows = spark.range(100).select((F.col("id") * 37 % 101).alias("k"))
    got = [{(r["k"], r["n"]) for r in ordering.dense_ids(rows.repartition(p), F.floor(F.col("k") / 10), [F.col("k")], "n").collect()} for p in (1, 13)]
    assert got[0] == got[1] == {(k, n + 1) for n, k in enumerate(sorted(i * 37 % 101 for i in range(100)))}


def test_bm25_languages(spark):
    docs = spark.createDataFrame([(0, "退款申请 服务 RefundService"), (1, "订单 查询"), (2, "english only")], "id INT, text STRING")
    ask = spark.createDataFrame([(0, "退款申请"), (1, "没有此词汇甲")], "q INT, t STRING")
    rows = retrieval.bm25(ask, docs, "q", "t", "id", "text").collect()
    assert [(r["query_id"], r["doc_id"]) for r in rows] == [(0, 0)]


def test_generic_actions_are_suppressed(spark):
    cols = "path STRING, url_ord INT, http STRING, file STRING, line INT, handler STRING, owner STRING"
    urls = spark.createDataFrame([(p, i, "GET", "f", i, f"h{i}", "O") for i, p in enumerate(["/refund/apply", "/refund/list", "/refund/cancel", "/refund/retryBatch"])], cols)
    words = spark.createDataFrame([("refund",)], "word STRING")
    paths = spark.createDataFrame([("/refund/apply",)], "path STRING")
    assert [r["path"] for r in coverage.extra_paths(urls, words, paths).collect()] == ["/refund/retryBatch"]
