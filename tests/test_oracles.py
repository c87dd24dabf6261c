"""Every query with SQL against DuckDB, over the smallest driver tables."""

from __future__ import annotations

import duckdb
import pytest

from threadmill import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name, tmp_path):
    catalog.QUERIES[name](spark, SF).write.parquet(str(tmp_path / "out"))
    con.execute(f"CREATE OR REPLACE TEMP TABLE a AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    con.execute(f"CREATE OR REPLACE TEMP TABLE b AS {catalog.ORACLES[name]}")
    columns = [sorted(r[0] for r in con.execute(f"DESCRIBE {t}").fetchall()) for t in "ab"]
    assert columns[0] == columns[1]
    names = ", ".join(columns[0])
    for x, y in ("ab", "ba"):
        assert con.execute(f"SELECT {names} FROM {x} EXCEPT ALL SELECT {names} FROM {y} LIMIT 3").fetchall() == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["contributor_pivot", "chunk_select", "sample_with_replacement", "dedup_candidates", "candidate_top1", "near_duplicate_merge"])
def test_partitions_change_nothing(spark, name):
    rows = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(str, catalog.QUERIES[name](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows[0] == rows[1]
