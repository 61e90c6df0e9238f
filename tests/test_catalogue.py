"""Registered queries against their SQL, over the smallest tables: those of files, snapshots, packs and second reviews."""

import glob
import os

import pytest

SF = "/root/testdata/sf0.001"
NAMES = ("markdown_inputs", "code_inputs", "load_verdicts", "load_items", "blanks_never_overwritten", "base_context", "block_packs", "extraction_pack_texts", "md_long_blocks", "java_shapes", "nearest_on_miss", "hit_evidence", "recheck_evidence", "evidence_snippets", "sample_ok", "nearest_name", "bm25_search")


def rounded(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_query_gives_the_rows_of_its_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = db.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted(repr([rounded(r[c]) for c in columns]) for r in got.collect()) == sorted(repr([rounded(r[i]) for i in at]) for r in want.fetchall())


def test_samples_do_not_depend_on_partitions(spark):
    from veritrace.operators import render

    rows = spark.range(500).withColumnRenamed("id", "item_id")
    one, seven = ([r[0] for r in render.sample(rows.repartition(n), 20, 3).collect()] for n in (1, 7))
    assert one == seven and len(set(one)) == 20 and one != [r[0] for r in render.sample(rows, 20, 4).collect()]
