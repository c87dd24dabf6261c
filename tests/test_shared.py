"""Pairs of a group's members that a large table has: against brute force, and what is moved for them."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadmill import catalog
from threadmill.functions.vectors import dot, unit
from threadmill.operators.shared import shared_by_group
from threadmill.operators.similarity import VectorTable, similar_to_each
from threadmill.plans import matching_queries


def shuffled(spark) -> int:
    """Bytes that all shuffles have written so far."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


@pytest.mark.parametrize("at_once", [1_000_000, 10])
def test_against_brute_force(spark, at_once):
    r = random.Random(at_once)
    ids = [-(2**63), 2**63 - 1, -7, 0, *range(1, 25)]
    groups = [(g, r.sample(ids, r.randint(0, 8)), r.sample(ids, r.randint(0, 8))) for g in range(40)] + [(99, ids, ids)]
    pairs = [(r.choice(ids), r.choice(ids)) for _ in range(150)] + [(5, x) for x in ids] + [(None, 1), (1, None)]
    found = shared_by_group(
        spark.createDataFrame(groups, "group long, lefts array<long>, rights array<long>"), spark.createDataFrame(pairs * 2, "left long, right long"), lists=True, pairs_at_once=at_once
    ).collect()
    expected = {(g, a): {b for b in rights if (a, b) in set(pairs)} for g, lefts, rights in groups for a in lefts}
    assert {(x["group"], x["left"]): set(x["shared"]) for x in found} == {k: v for k, v in expected.items() if v}
    assert all(x["n_shared"] == len(x["shared"]) for x in found)


def test_no_pairs(spark):
    groups = spark.createDataFrame([(1, [1, 2], [3])], "group long, lefts array<long>, rights array<long>")
    assert shared_by_group(groups, spark.createDataFrame([], "left long, right long")).count() == 0
    assert shared_by_group(groups.where("false"), spark.createDataFrame([(1, 3)], "left long, right long")).count() == 0


def test_a_large_customer_is_no_table_of_pairs(spark, tmp_path):
    n = 1200
    parts = random.Random(1).sample(range(10**6), n)
    spark.createDataFrame([(i, 1) for i in range(n)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, i, parts[i]) for i in range(n)], "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # small tables are moved like large ones
    try:
        before = shuffled(spark)
        rows = catalog.QUERIES["shared_publications"](spark, str(tmp_path)).collect()
        moved = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted((r["cust"], r["supp"], r["n_shared"]) for r in rows) == [(1, i, 1) for i in range(n)]
    assert moved < 300 * n  # a row for each of its n * n pairs would be megabytes


@pytest.mark.parametrize("name, moved", [("resolve_phd", r"hashpartitioning\(\(?[a-z_]+#\d+L? % "), ("supervisor_evidence", r"hashpartitioning\(cand#\d+L?, doi#")])
def test_no_row_for_each_vector_or_publication_is_moved(spark, name, moved):
    """Vectors are not dealt out to the works that are compared, nor a contributor's hits to the publications of its thesis."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "hashpartitioning" in plan and not re.search(moved, plan)


def test_lists_of_works_are_not_moved(spark):
    """Contributors go to where the candidate's works are; what then is left to do moves no thesis."""
    plan = catalog.QUERIES["author_relations"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((integer_id|author_id|_phd)#", plan)


def test_blocks_and_many_vectors_change_nothing(spark, monkeypatch):
    query = lambda: sorted(map(repr, catalog.QUERIES["author_relations"](spark, "/root/testdata/sf0.001").collect()))
    whole = query()
    monkeypatch.setattr(matching_queries, "_LINES_AT_ONCE", 2500)
    monkeypatch.setattr(matching_queries, "_THESES_AT_ONCE", 600)
    assert query() == whole
    monkeypatch.setattr(matching_queries, "_MAX_BROADCAST_BYTES", 0)
    assert query() == whole


def test_more_vectors_than_can_be_broadcast_are_not_moved(spark, monkeypatch):
    """They are compared where the theses are: a row for each thesis and work, with two vectors, was moved."""
    query = lambda: sorted(map(repr, catalog.QUERIES["phd_flags"](spark, "/root/testdata/sf0.001").collect()))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        few = query()
        between = shuffled(spark)
        monkeypatch.setattr(matching_queries, "_MAX_BROADCAST_BYTES", 0)
        many = query()
        after = shuffled(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert many == few and after - between < 0.25 * (between - before)


def test_vectors_that_are_too_many_to_send_change_nothing(spark, monkeypatch):
    query = lambda: sorted(map(repr, catalog.QUERIES["resolve_phd"](spark, "/root/testdata/sf0.001").collect()))
    few = query()
    monkeypatch.setattr(matching_queries, "_MAX_BROADCAST_BYTES", 0)
    monkeypatch.setattr(matching_queries, "_MAX_SENT_BYTES", 0, raising=False)
    assert query() == few


def test_vectors_by_place_are_compared_as_spark_does(spark):
    vectors = {0: [1.0, 2.0], 1: [2.0, -1.0], 2: [0.0, 0.0], 3: [1.0], 4: [], 6: [float("nan"), 1.0], 7: [3.0, 4.5]}
    sent = VectorTable(np.array(list(vectors)), pa.chunked_array([pa.array(list(vectors.values())[:4], pa.list_(pa.float32())), pa.array(list(vectors.values())[4:], pa.list_(pa.float32()))]), 8)
    places = [0, 1, 2, 3, 4, 6, 7, -1, 8]
    rows = spark.createDataFrame([(a, b) for a in range(-1, 9) for b in (places, [], None)], "a long, b array<long>")
    known = spark.createDataFrame([(a, b, vectors[a], vectors[b]) for a in vectors for b in vectors], "a long, b long, x array<float>, y array<float>")
    expected = {(r["a"], r["b"]): r["s"] for r in known.select("a", "b", F.round(dot(unit(F.col("x")), unit(F.col("y"))), 6).alias("s")).collect()}
    for r in rows.select("a", "b", similar_to_each(spark.sparkContext.broadcast(sent))("a", "b").alias("s")).collect():
        if r["a"] not in vectors:
            assert r["s"] is None
        else:
            assert len(r["s"]) == len(r["b"] or []) and all(repr(s if s is None else round(s, 6)) == repr(expected.get((r["a"], b))) for s, b in zip(r["s"], r["b"] or []))
