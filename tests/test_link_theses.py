"""Resolution from end to end on a small catalogue."""

from __future__ import annotations

import pytest

from threadmill import schemas
from threadmill.operators.resolution import deduplicate_candidates
from threadmill.plans.resolution import Catalogue, link_theses, pilot_map, reports


def place(name, country, years):
    return {"institution": {"display_name": name, "country_code": country}, "years": years}


@pytest.fixture(scope="module")
def pubs(spark):
    rows = [
        (1, "T1", "U", "Anna Smith", "Deep theory of nets", 2020, None, ["Jan de Vries", None, "Nobody Known", "Piet Bos"]),
        (2, "T2", "U", "Anna Smith", "Something else", 2020, None, []),
        (3, "T3", "U", "Not Listed", "X", 2020, None, ["Jan de Vries"]),
        (4, "T4", "U", "Bob Away", "No such title anywhere", 2020, None, ["Jan de Vries"]),
    ]
    return spark.createDataFrame(rows, schemas.PUBS)


@pytest.fixture(scope="module")
def catalogue(spark):
    authors = [
        ("A1", "A. Smith", "O1", [place("U", "NL", [2018, 2020])]), ("A2", "Zoe Smith", None, []), ("A3", "Bob Away", "", [place("W", "US", [2020])]),
        ("S1", "J. de Vries", "O9", [place("U", "NL", [2019]), place("V", "BE", [2019])]), ("S2", "Jan Vries", None, [place("U", "BE", [2019])]), ("S3", "Piet Bos", None, [place("Q", "NL", [2020])]),
    ]
    works = [("W1", "Deep Theory of Nets!", "d1", 2020, "x"), ("W2", "Late work", "d2", 2030, "x"), ("W3", None, None, 2019, "x"), ("W4", "Other", "d4", 2019, "x")]
    ships = [("A1", "W1"), ("A1", "W2"), ("A1", "W3"), ("S1", "W1"), ("S2", "W2"), ("S2", "W3"), ("S3", "W4"), ("A3", "W4")]
    search = [("Anna Smith", 0, "A2"), ("Anna Smith", 1, "A1"), ("Jan de Vries", 0, "S2"), ("Jan de Vries", 1, "S1"), ("Piet Bos", 0, "S3"), ("Bob Away", 0, "A3")]
    make = spark.createDataFrame
    return Catalogue(make(authors, schemas.AUTHORS), make(works, schemas.WORKS), make(ships, schemas.AUTHORSHIPS), make(search, schemas.AUTHOR_SEARCH), make([("S1",)], "author_id string"))


@pytest.fixture(scope="module")
def rows(pubs, catalogue):
    out = link_theses(pubs, catalogue)
    assert tuple(out.columns) == schemas.RELATIONS
    return {(r["integer_id"], r["contributor_rank"]): r for r in out.collect()}


def test_one_row_per_contributor_or_a_placeholder(rows):
    assert set(rows) == {(1, 1), (1, 2), (1, 3), (2, None), (3, 1), (4, 1)}


def test_candidate(rows):
    r = rows[1, 1]
    assert (r["phd_id"], r["phd_name"], r["phd_orcid"], r["n_name_search_matches"], r["phd_match_by"]) == ("A1", "A. Smith", "O1", 2, "ranking")
    assert r["exact_match"] and r["affiliation_match"] and r["phd_match_score"] == 91 and r["title_catalogue"][0] == "Deep Theory of Nets!"
    assert rows[2, None]["phd_match_by"] == "ranking" and rows[2, None]["phd_match_score"] == 20
    assert rows[3, 1]["phd_id"] is None and rows[3, 1]["phd_name"] == "Not Listed"
    assert rows[4, 1]["phd_id"] == "A3" and rows[4, 1]["phd_match_by"] is None and rows[4, 1]["phd_orcid"] is None


def test_contributors(rows):
    r = rows[1, 1]
    assert (r["contributor_id"], r["name_matches_catalogue"], r["contributor_orcid"]) == (["S1", "S2"], ["J. de Vries", "Jan Vries"], ["O9", None])
    assert (r["contributor_confirmed"], r["same_grad_inst"], r["n_shared_inst_grad"], r["is_sup_in_pilot_dataset"], r["is_thesis_coauthor"]) == (True, True, 1, True, True)
    assert (sorted(r["shared_pubs"]), r["n_shared_pubs"]) == (["d1", "d2"], 2)
    assert (rows[1, 2]["contributor_name"], rows[1, 2]["sup_match_by"]) == ([], "")
    assert (rows[1, 3]["contributor_name"], rows[1, 3]["contributor_confirmed"]) == (["Piet Bos"], False)
    assert rows[4, 1]["contributor_name"] == [] and rows[3, 1]["contributor_name_source"] == "Jan de Vries"


def test_dedup_and_reports(spark, pubs, catalogue):
    from pyspark.sql import functions as F

    out = link_theses(pubs, catalogue).withColumn("row_id", F.col("integer_id") * 100 + F.coalesce("contributor_rank", F.lit(0)))
    kept = deduplicate_candidates(out)
    assert {r["integer_id"] for r in kept.collect()} == {1, 3, 4}
    done = reports(pubs, out)
    m = done.metrics.first()
    assert (m["n_phds"], m["n_found"], m["n_confirmed"], m["n_contributors"], m["n_confirmed_contributors"]) == (4, 3, 2, 5, 1)
    assert sum(r["n"] for r in done.candidates.collect()) == 4
    assert [r["phd_name"] for r in done.not_found.collect()] == ["Not Listed"]


def test_pilot_map(spark, tmp_path):
    supervisors = spark.createDataFrame([("Vries, Jan de",), ("Nobody",)], "supervisor string")
    found = spark.createDataFrame([("q", 0, "S1", "Jan de Vries", None, None), ("q", 1, "S7", "Jan de Vries", None, None)], "query_name string, api_rank int, author_id string, display_name string, orcid string, processing_error string")
    assert [tuple(r) for r in pilot_map(supervisors, found, str(tmp_path / "p")).collect()] == [("Jan de Vries", "S7")]
