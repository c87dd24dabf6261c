"""Spreadsheets, sinks, model encoders, joins in order, and where stages are written."""

from __future__ import annotations

import io
import time
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmill import stages
from threadmill.operators import people as P
from threadmill.operators import relational as R
from threadmill.operators import sampling as S
from threadmill.operators import similarity
from threadmill.plans import cleaning_queries, matching_queries, tables
from threadmill.functions.names import names_agree
from threadmill.sources import files

_HEAD = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'


def workbook(*rows):
    """A small XLSX: the first column as shared strings, the second one inline."""
    out, strings, body = io.BytesIO(), [], ""
    for n, (a, b) in enumerate(rows, 1):
        cells = ""
        if a is not None:
            cells += f'<c r="A{n}" t="s"><v>{len(strings)}</v></c>'
            strings.append(a)
        if b is not None:
            cells += f'<c r="B{n}" t="inlineStr"><is><t>{b}</t></is></c>'
        body += f'<row r="{n}">{cells}</row>'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">' + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"{_HEAD}{body}</sheetData></worksheet>")
    return out.getvalue()


def test_spreadsheets_are_harvested_once(spark, tmp_path):
    web = {
        "https://host/tree/data": b'<a href="/x/one.xlsx"><a href="two.xlsx"><a href="two.xlsx"><a href="no.csv">',
        "https://host/raw/refs/heads/data/one.xlsx": workbook(("year", "supervisor"), ("1", "A. Vos"), ("2", None), (None, "B. Vos")),
        "https://host/raw/refs/heads/data/two.xlsx": workbook(("supervisor", "x"), ("A. Vos", "1"), ("C. Vos", None)),
    }
    asked = []

    def fetch(url):
        asked.append(url)
        return web[url]

    for _ in range(2):
        got = files.harvest_spreadsheets(spark, "https://host/tree/data", fetch, str(tmp_path / "sheets"))
        assert {r["supervisor"] for r in got.collect()} == {"A. Vos", "B. Vos", "C. Vos"} and got.count() == 3
    assert len(asked) == 4 and len(set(asked)) == 3
    with pytest.raises(Exception, match="missing columns: nobody"):
        files.read_spreadsheets(spark, str(tmp_path / "sheets/*.xlsx"), "nobody").collect()


def test_sinks(spark, tmp_path):
    c = P.classify_contributors(spark.createDataFrame([("Jan Jansen",), ("University of X",), ("Madonna",)], "contributor string"))
    files.write_classified(c, str(tmp_path))
    assert [r["contributor"] for r in spark.read.option("header", True).csv(f"{tmp_path}/rejected").collect()] == ["University of X"]
    assert [r["contributor"] for r in spark.read.option("header", True).csv(f"{tmp_path}/review").collect()] == ["Madonna"]
    rows = spark.createDataFrame([(1, ["a", "b"], None), (2, None, "timed out")], "integer_id long, ids array<string>, processing_error string")
    files.write_relations(rows, rows.where("integer_id = 1"), str(tmp_path))
    read = lambda name: files.read_nested_csv(spark, f"{tmp_path}/{name}", rows.schema).orderBy("integer_id").collect()
    assert read("relations") == rows.collect() and [r["integer_id"] for r in read("relations_deduplicated")] == [1]
    assert [r["processing_error"] for r in read("exceptions")] == ["timed out"]


def test_model_encoder(spark):
    load = lambda: lambda texts: np.array([[len(t), t.count("a")] for t in texts], float)
    pairs = spark.createDataFrame([("Aab!", "aab"), ("bb", "aa"), (None, "x"), ("", "x")], "t string, r string")
    got = similarity.ngram_similarity(pairs, "t", "r", similarity.model_encoder("test", load)).collect()
    by = {r["t"]: r["similarity"] for r in got}
    assert by["Aab!"] == pytest.approx(1.0) and by["bb"] == pytest.approx(2**-0.5) and by[None] is by[""] is None


def test_a_key_that_is_there_twice_is_an_error(spark):
    sample = spark.createDataFrame([(7, 0), (8, 1), (9, 2)], "k long, position long")
    table = spark.createDataFrame([(7, "a"), (9, None), (5, "x"), (5, "y")], "k long, v string")
    assert [tuple(r) for r in R.align_to(sample, table, "k", "position").collect()] == [(0, 7, "a"), (1, 8, None), (2, 9, None)]
    with pytest.raises(Exception, match="k occurs more than once: 7"):
        R.align_to(sample, table.unionByName(table), "k", "position").collect()


@pytest.mark.parametrize(("n", "size", "index"), [(0, 3, 0), (1, 3, 0), (10, 3, 0), (10, 3, 2), (10, 3, 3), (10, 3, 99), (9, 3, 2), (9, 3, 3), (5, 100, 0)])
def test_chunks(spark, n, size, index):
    keys = sorted((i * 7919) % 1000 for i in range(n))
    got = sorted(r["k"] for r in R.chunk(spark.createDataFrame([(k, "x") for k in reversed(keys)], "k long, v string"), "k", size, index).collect())
    at = min(index, max((n - 1) // size, 0))
    assert got == keys[at * size : (at + 1) * size]


def test_pandas_samples_are_for_small_tables(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_NUMPY_ROWS", 9)
    with pytest.raises(ValueError, match="too many"):
        S.numpy_sample(spark.range(10), 2, 1, "id")


def test_numpy_sample_takes_what_pandas_takes(spark):
    import pandas as pd

    got = {r["position"]: r["id"] for r in S.numpy_sample(spark.range(100, 160), 20, 42, "id").collect()}
    assert [got[i] for i in range(20)] == pd.DataFrame({"id": range(100, 160)}).sample(20, random_state=42)["id"].tolist()


def test_columns_to_rows_and_counts(spark):
    wide = spark.createDataFrame([(1, "a", None, "b"), (2, None, None, None)], "id int, c_1 string, c_2 string, c_10 string")
    assert sorted(map(tuple, R.columns_to_rows(wide, ["id"], "c_").collect())) == [(1, 1, "a"), (1, 10, "b")]
    assert tuple(R.rows_removed(wide, wide.where("id = 1")).first()) == (2, 1, 1)
    got = wide.select(R.common_elements(F.array(F.lit("a"), F.lit("b")), F.array("c_10")).alias("x")).collect()
    assert [r["x"] for r in got] == [["b"], None]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = spark.conf

    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stages.shared_folder(Session())


def test_block_join_of_lines_equals_all_pairs(spark, tmp_path):
    texts = ["Jan Vos\n\nsee  Anna Smith-Jones\nx", "A. Jones", None, "Ring, red\nB. Vos"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "J. Vos\nAlice Jones")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([("red ring",), ("blue ring",)], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    lines = {" ".join(x.split()) for t in texts if t for x in t.split("\n")} - {""}
    assert {r["name"] for r in tables.text_lines(spark, str(tmp_path)).collect()} == lines
    known = ["J. Vos", "Alice Jones", "red ring", "blue ring"]
    got = {tuple(r) for r in cleaning_queries.name_block_join_documents(spark, str(tmp_path)).collect()}
    assert got == {(a, b) for a in lines for b in known if names_agree(a, b)} and len(got) >= 3


@pytest.mark.parametrize("lists", [False, True])
def test_relations_leave_two_stages_only(spark, lists):
    """Contributors and best candidates: candidates and known pairs go as soon as they have been used."""
    there = lambda: {p.name for p in Path(stages.shared_folder(spark).removeprefix("file:")).iterdir() if p.name.startswith(("stage-", "shared-"))}
    before = there()
    matching_queries.relations(spark, "/root/testdata/sf0.001", lists=lists)
    left = there() - before
    assert len(left) == 2 and all(name.startswith("stage-") for name in left)


def test_what_was_moved_for_a_stage_is_gone_when_it_is_written(spark):
    def moved() -> set[str]:
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = moved()
    df, path = stages.written(spark.range(1000).repartition(3, "id"))
    for _ in range(20):
        if not moved() - before:
            break
        time.sleep(0.2)
    assert not moved() - before and df.distinct().count() == 1000
    stages.remove(spark, path)
