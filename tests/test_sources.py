"""Files, settings, the lookup service's policy, and cleaning from end to end."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from threadmill.config import CleanConfig
from threadmill.plans.cleaning import clean_pairs, labelling_sample
from threadmill.schemas import PAIRS
from threadmill.sources import files, lookup, service
from threadmill.streaming.cleaning import classify_stream


def test_csv_null_tokens_quotes_and_line_breaks(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('name,n\n"a ""b"", c",1\n"two\nlines",x\nNA,3\n,4\n')
    got = [tuple(r) for r in files.read_csv(spark, str(p), "n int, name string").collect()]
    assert got == [(1, 'a "b", c'), (None, "two\nlines"), (3, None), (4, None)]
    with pytest.raises(ValueError, match="year"):
        files.read_csv(spark, str(p), "year int")


def test_nested_csv_comes_back(spark, tmp_path):
    schema = "id long, a array<string>, d array<struct<k: long, v: string>>"
    df = spark.createDataFrame([(1, ["x", "y"], [(1, "a")]), (2, None, None)], schema)
    files.write_csv(df, str(tmp_path / "out"))
    assert sorted(map(str, files.read_nested_csv(spark, str(tmp_path / "out"), schema).collect())) == sorted(map(str, df.collect()))


def test_lists(spark, tmp_path):
    p = tmp_path / "l.txt"
    p.write_text("# c\n\n 12 \n7\n")
    assert [r[0] for r in files.read_ids(spark, str(p)).collect()] == [12, 7]


def test_read_through_builds_once(spark, tmp_path):
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    at = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        files.read_snapshot(spark, at)
    assert files.read_through(spark, at, build).count() == files.read_through(spark, at, build).count() == 3
    assert calls == [1]


def test_config_and_dataset(spark, tmp_path, monkeypatch):
    data = tmp_path / "d.csv"
    data.write_text("integer_id,phd_name,domain\n" + "".join(f"{i},{'NA' if i == 3 else 'n'},{'x' if i % 2 else 'y'}\n" for i in range(10)))
    cfg = tmp_path / "c.yaml"
    cfg.write_text(f"dataset_path: {data}\noutput_filename: o\noutput_filename_gold_standard: g\nuse_sample_for_gold_standard: true\nchunk: \nnrows: \ndomain: x\nother: 1\n")
    monkeypatch.setenv("DATASET_CONFIG", str(cfg))
    c = files.read_config("nowhere")
    assert (c.input_path, c.output_path) == (str(data), "g")
    schema = "integer_id long, phd_name string, domain string"
    assert sorted(r[0] for r in files.read_dataset(spark, c, schema).collect()) == [1, 5, 7, 9]
    monkeypatch.delenv("DATASET_CONFIG")
    plain = files.DatasetConfig(str(data), "o", nrows=4, chunk=1)
    assert sorted(r[0] for r in files.read_dataset(spark, plain, schema).collect()) == [4, 5, 6, 7]
    assert files.read_dataset(spark, files.DatasetConfig(str(data), "o", nrows=4), schema).count() in (3, 4)


def test_backoff_and_headers():
    assert [service.backoff(k) for k in range(6)] == [1, 2, 4, 8, 10, 10]
    assert (service.backoff(0, 3), service.backoff(0, 99), service.backoff(0, -1)) == (3, 10, 0)
    assert (service.numeric_header({"a": "1.5"}, "A"), service.numeric_header({"a": "x"}, "A"), service.numeric_header({}, "A")) == (1.5, None, None)
    assert (service.whole_seconds(-3.2), service.whole_seconds(2.9), service.whole_seconds(None)) == (0, 2, None)


def test_budget():
    summary = service.rate_limit_summary({"rate_limit": {"daily_remaining_usd": 0, "resets_in_seconds": -5, "endpoint_costs_usd": {"a": 1}}})
    assert (summary["resets_in_seconds"], summary["endpoint_costs_usd"], summary["daily_budget_usd"]) == (0, {"a": 1.0}, None)
    with pytest.raises(service.QuotaExceededError):
        service.check_budget(summary)
    service.check_budget({**summary, "prepaid_remaining_usd": 2.0})
    service.check_budget({})


def test_client_retries_then_caches():
    replies = [service.Response(429, headers={"Retry-After": "7"}), service.Response(429), service.Response(200, {"x": 1})]
    slept, asked = [], []
    client = service.Client(lambda url, limits: asked.append(limits) or replies.pop(0), slept.append)
    assert client.get("u").body == {"x": 1} and client.get("u").status == 200
    assert slept == [7, 2] and asked == [(5.0, 20.0)] * 3
    busy = service.Client(lambda url, limits: service.Response(429), slept.append)
    assert busy.get("u").status == 429
    with pytest.raises(service.QuotaExceededError):
        service.Client(lambda url, limits: service.Response(429, text="Daily limit"), slept.append).get("u")


def test_search_source(spark, tmp_path):
    def transport(url, limits):
        from threadmill.sources.service import Response

        return Response(500) if url.endswith("bad") else Response(200, {"results": [{"id": f"A{url[-1]}{k}", "display_name": "same", "orcid": None} for k in range(2)]})

    source = lookup.search_source("people_search", transport, ["x", "y", "bad", "x"], lambda n: f"q/{n}")
    got = lookup.land_search(spark, source, str(tmp_path / "s")).collect()
    assert sorted((r["query_name"], r["api_rank"] if r["api_rank"] is not None else -1) for r in got) == [("bad", -1), ("x", 0), ("x", 1), ("y", 0), ("y", 1)]
    assert [r["processing_error"] for r in got if r["query_name"] == "bad"] == ["status 500"]
    assert [tuple(r) for r in lookup.name_to_id(spark.read.parquet(str(tmp_path / "s"))).collect()] == [("same", "Ay1")]


def pairs(spark):
    row = lambda i, c, y, k: (i, f"T{i}", c, k, "uu", "Jansen, J.", "t", y, None, k)
    rows = [row(1, "Vries, Jan de", 2015, 0), row(1, "Department of X", 2015, 1), row(1, "Anna Smith", 2015, 2), row(1, None, 2015, 3), row(2, "Anna Smith", 2010, 4), row(3, "Nel Wognum", 2022, 5), row(4, "Research Group", 2016, 6)]
    return spark.createDataFrame(rows, PAIRS)


def test_cleaning(spark):
    done = clean_pairs(pairs(spark))
    got = {r["integer_id"]: (r["phd_name"], r["contributors"]) for r in done.pubs.collect()}
    assert got == {1: ("J. Jansen", ["Jan de Vries", "Anna Smith"]), 3: ("J. Jansen", ["Nel Wognum"])}
    assert {r["integer_id"]: len(r["contributors"]) for r in done.pubs_raw.collect()} == {1: 3, 3: 1, 4: 1}
    sample, cleaned = labelling_sample(done, spark.createDataFrame([(3,)], "integer_id long"), CleanConfig(sample_rows=2))
    assert sorted(r["integer_id"] for r in sample.collect()) == [1, 4]
    assert {r["integer_id"]: r["phd_name"] for r in cleaned.collect()} == {1: "J. Jansen", 4: None}


def test_stream_of_pairs(spark, tmp_path):
    pairs(spark).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(pairs(spark).schema).parquet(str(tmp_path / "in"))
    query = classify_stream(stream, lambda df, epoch: seen.extend(r["contributor_decision"] for r in df.collect()), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert sorted(seen) == ["accept"] * 4 + ["reject"] * 2 + ["review"]


@pytest.mark.parametrize("broken", [False, True])
def test_entry_without_the_corpus_operators(tmp_path, broken):
    """In a copy of the repository without them, or with one that cannot be imported, the other queries are there."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "threadmill", tmp_path / "threadmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if broken:
        (tmp_path / "threadmill/llm").mkdir()
        (tmp_path / "threadmill/llm/__init__.py").write_text("")
        (tmp_path / "threadmill/llm/registry.py").write_text("import a_package_that_is_not_there")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'contributor_pivot' in q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""}, check=False)
    assert done.returncode == 0, done.stderr
    assert ("a_package_that_is_not_there" in done.stderr) == broken


def test_logs(tmp_path):
    from threadmill.sources import runlog

    log = runlog.open_logs(str(tmp_path), "t")
    with runlog.at_row(integer_id=7):
        log.info("looked")
        log.info(runlog.PROGRESS + "half way")
    log.info("done")
    run, progress = ((tmp_path / f).read_text() for f in ("run.log", "progress.log"))
    assert "[integer_id=7] looked" in run and "[-] done" in run and progress.count("\n") == 1 and "half way" in progress
