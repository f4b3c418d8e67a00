"""Every registered query against its SQL on the smallest tables."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from cairnlake.operators import prune

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got, want = entry.queries()[name](spark, DIR).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[cols].values.tolist())
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["live_set", "pack_classify", "prune_totals", "dead_chunks"])
def test_references_are_not_dealt_by_snapshot(spark, name):
    plan = entry.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(snapshot" not in plan


@pytest.mark.parametrize("name", ["pack_classify", "prune_totals", "dead_chunks"])
def test_join_with_live_chunks_is_dealt_by_size(spark, monkeypatch, name):
    monkeypatch.setattr(prune, "TASK_BYTES", 4 << 10)
    orders, lineitem = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("orders", "lineitem"))
    n = prune.tasks_for(orders, lineitem)
    assert n > 4  # partitions of a shuffle in these tests
    plan = entry.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(rf"hashpartitioning\(chunk_id#\d+L, {n}\), REPARTITION_BY_NUM", plan)) == 2
    test_query(spark, name)


def test_prune_totals_goes_through_the_packs_once(spark):
    plan = entry.queries()["prune_totals"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[c_custkey", plan)) == 1


def test_totals_before_a_prune_are_those_after_it(spark):
    rows = spark.createDataFrame([(1, 10, "keep"), (2, 20, "delete"), (3, 5, "rewrite"), (4, None, "delete")], "pack_id long, bytes long, action string")
    for df in (rows, rows.limit(0), rows.where("action = 'delete'")):
        assert prune.planned_stats(df).first() == prune.prune_stats(df, df.where("action <> 'delete'")).first()


def test_tables_of_unknown_size_are_not_dealt(spark):
    assert prune.tasks_for(spark.createDataFrame([(1,)], "chunk_id long")) == 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
