"""Contributor counts of works with more contributors than any given table has."""

from __future__ import annotations

import datetime

from threadmill.plans.cleaning_queries import contributor_count_flag


def test_long_lists_are_counted_in_whole(spark, tmp_path):
    lines = [(1, i, i, 1, 1.0, 1.0) for i in range(25)] + [(2, i, i, 1, 1.0, 1.0) for i in range(4)] + [(3, 0, 0, 1, 1.0, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, datetime.date(1999, 1, 1)) for k in (1, 2, 3)], "o_orderkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, f"s{i}") for i in range(25)], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {(r["integer_id"], r["contributor_count"]) for r in contributor_count_flag(spark, str(tmp_path)).collect()}
    assert got == {(1, 25), (2, 4)}
