"""Registered queries over tables of their own: many rows of one key, and numbers of other lengths."""

import pytest

import __spark_entry__ as entry


def same_as_sql(spark, folder, name):
    import duckdb

    db = duckdb.connect()
    for f in folder.glob("*.parquet"):
        db.execute(f"create view {f.stem} as select * from '{f}{'/*.parquet' if f.is_dir() else ''}'")
    got = entry.queries()[name](spark, str(folder))
    want = db.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in want.description].index(c) for c in got.columns]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
    return got


def joined_rows(df):
    """Rows that joins of a query that has run gave."""

    def under(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return under(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return under(plan.plan())
        own = plan.metrics().apply("numOutputRows").value() if "Join" in kind else 0
        return own + sum(under(plan.children().apply(i)) for i in range(plan.children().size()))

    return under(df._jdf.queryExecution().executedPlan())


def test_endpoints_of_one_path_are_counted_before_they_are_met(spark, tmp_path):
    spark.range(500).selectExpr("id AS o_orderkey", "id * 50 AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(300).selectExpr("id * 60 % 900 AS c_custkey").union(spark.range(1, 40).selectExpr("id AS c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    assert joined_rows(same_as_sql(spark, tmp_path, "url_lookup")) <= 339  # a row for each one who asks, not 500


@pytest.mark.parametrize("path, norm", [(None, None), ("", "/"), ("/", "/"), ("//", "/"), ("a/", "/a"), (" a//b/{id}/?q=1\n/ ", "/a/b/{}"), ("a/\n/", "/a/\n"), ("{x}", "/{}"), ("?a", "/")])
def test_paths_are_normalised_in_single_steps(spark, path, norm):
    from pyspark.sql import functions as F

    from veritrace.functions import text as X

    rows = spark.createDataFrame([(path,)], "path STRING").select(X.norm_url(F.col("path")).alias("norm"))
    assert rows.first()["norm"] == norm
    assert rows._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 6


def test_only_codes_that_are_called_so_are_listed(spark, tmp_path):
    keys = spark.createDataFrame([(n,) for n in (1, 2, 9999, 10000, 10001, 12345, 89999, 90001, 99999, 100001)], "p_partkey BIGINT")
    keys.selectExpr("p_partkey", "'blue red' AS p_name", "'Brand#12' AS p_brand").write.parquet(str(tmp_path / "part.parquet"))
    same_as_sql(spark, tmp_path, "identifier_extract")


def test_best_documents_are_chosen_where_they_are_read(spark):
    import math
    import random

    from veritrace.operators import retrieval

    rng = random.Random(5)
    words = [f"word{i}" for i in range(60)]
    said = lambda n: " ".join(rng.choice(words[: rng.choice((6, 60))]) for _ in range(n))
    docs = [(i, said(rng.randrange(0, 40))) for i in range(400)]
    docs += [(i + 400, docs[i // 4][1]) for i in range(80)] + [(480, None), (481, "nothing of it")]
    asked = [(i, said(rng.randrange(1, 8))) for i in range(300)] + [(7, "word59 word58"), (300, ""), (301, None), (302, "absent")]
    rows = retrieval.bm25(spark.createDataFrame(asked, "q INT, t STRING"), spark.createDataFrame(docs, "id INT, text STRING").repartition(3), "q", "t", "id", "text", 4, 0.3)
    got = {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 7)) for r in rows.collect()}
    texts = {i: (t or "").split() for i, t in docs}
    mean, df = sum(map(len, texts.values())) / len(texts), {w: sum(w in t for t in texts.values()) for w in words}
    want = {}
    for q in range(300):
        scores = {}
        for w in {w for i, t in asked if i == q for w in t.split()}:
            for i, t in texts.items():
                if f := t.count(w):
                    scores[i] = scores.get(i, 0) + math.log((len(texts) - df[w] + 0.5) / (df[w] + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / mean))
        best = sorted((-round(s, 9), i) for i, s in scores.items())[:4]
        want |= {(q, n + 1): (i, round(-s, 7)) for n, (s, i) in enumerate(best) if s <= 0.3 * best[0][0]}
    assert got == want and len(want) > 600
    assert joined_rows(rows) == 0  # pairs of a query and a document had met as rows
    none = spark.createDataFrame([], "id INT, text STRING")
    assert retrieval.bm25(spark.createDataFrame(asked, "q INT, t STRING"), none, "q", "t", "id", "text").collect() == []
    assert retrieval.bm25(none, spark.createDataFrame(docs, "id INT, text STRING"), "id", "text", "id", "text").collect() == []
