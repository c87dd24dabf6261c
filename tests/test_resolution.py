"""Evidence, results, de-duplication and reports on hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from threadmill.config import MatchConfig
from threadmill.functions import categories as C
from threadmill.functions.vectors import cosine
from threadmill.operators import relational as R
from threadmill.operators import resolution as M
from threadmill.operators import sampling as S
from threadmill.operators.similarity import ngram_similarity
from threadmill.schemas import AUTHORS, RELATIONS

DEDUP = "row_id long, integer_id long, thesis_identifier string, institution string, phd_name string, phd_id string, phd_orcid string, contributor_confirmed boolean"


def dedup(spark, rows, extra=False):
    data = [(k, i, f"T{i}", f"I{i}", f"N{i}", a, o, c) for k, (i, a, o, c) in enumerate(rows)]
    df = spark.createDataFrame(data, DEDUP)
    if extra:
        df = df.select("row_id", "integer_id", "thesis_identifier", "institution", "phd_name", "phd_id", "phd_orcid", F.lit(3).alias("n_name_search_matches"), "contributor_confirmed")
    out = M.deduplicate_candidates(df)
    rows = out.orderBy("row_id").collect()
    return out.columns, [(r["integer_id"], [d["integer_id"] for d in r["duplicate_phds"]] if r["duplicate_phds"] else None) for r in rows]


def test_most_confirmed_stays(spark):
    columns, got = dedup(spark, [(1, "A1", "O1", True), (2, "A2", "O1", True), (2, "A2", "O1", True), (3, "A3", "O1", False)], extra=True)
    assert got == [(2, [2, 1, 3]), (2, [2, 1, 3])]
    assert columns.index("duplicate_phds") == columns.index("n_name_search_matches") + 1


def test_on_a_tie_the_first_stays(spark):
    assert dedup(spark, [(2, "A1", "O1", True), (1, "A1", "O1", True)])[1] == [(2, [2, 1])]


def test_author_id_where_there_is_no_orcid(spark):
    columns, got = dedup(spark, [(1, "A1", "", False), (2, "A1", None, True), (3, None, None, False)])
    assert got == [(2, [2, 1]), (3, None)] and columns[-1] == "duplicate_phds"


def test_orcid_comes_before_author_id(spark):
    assert dedup(spark, [(1, "A1", "O1", True), (2, "A1", "O2", True)])[1] == [(1, None), (2, None)]


def test_dedup_twice_is_dedup_once(spark):
    rows = [(1, "A1", "O1", True), (2, "A2", "O1", False), (3, "A3", None, True)]
    first = dedup(spark, rows)[1]
    assert [i for i, _ in dedup(spark, [rows[i - 1] for i, _ in first])[1]] == [i for i, _ in first]


def evidence(spark, works, candidates=((1, "a", 0, False),)):
    c = spark.createDataFrame(list(candidates), "integer_id long, author_id string, api_rank int, affiliation_match boolean")
    w = spark.createDataFrame(works, "integer_id long, author_id string, work_id string, title string, similarity double")
    return M.candidate_evidence(c, w)


@pytest.mark.parametrize(("sims", "want"), [
    ([0.99], (True, True, 1, 71)), ([0.9899], (False, True, 1, 21)), ([0.9], (False, True, 1, 21)), ([0.8999], (False, False, 1, 1)), ([0.7], (False, False, 1, 1)), ([0.6999], (False, False, 0, 0)),
    ([None], (False, False, 0, 0)), ([], (False, False, 0, 0)), ([1.0, None, 0.75], (True, True, 2, 72)),
])
def test_tiers_and_score(spark, sims, want):
    r = evidence(spark, [(1, "a", f"w{k}", "t", s) for k, s in enumerate(sims)]).first()
    assert (r["exact_match"], r["near_exact_match"], r["n_close_matches"], r["match_score"]) == want
    assert r["max_similarity"] == (0.0 if not sims else max((s for s in sims if s is not None), default=None))


def test_best_candidate_ties_go_to_the_search_rank(spark):
    rows = evidence(spark, [(1, "b", "w", "t", 0.8), (1, "a", "w", "t", 0.8), (1, "c", "w", "t", None)], [(1, "a", 1, False), (1, "b", 0, False), (1, "c", 2, True)])
    assert M.best_candidate(rows).first()["author_id"] == "c"  # 20 for the affiliation
    assert M.best_candidate(rows.where("author_id <> 'c'")).first()["author_id"] == "b"


def authors(spark):
    place = lambda n, c, y: {"institution": {"display_name": n, "country_code": c}, "years": y}
    return spark.createDataFrame([("a", "A", None, [place("U", "NL", [2000]), place("V", "BE", [2019, 2020])]), ("b", "B", None, [place("V", "BE", [2020])]), ("c", "C", None, None)], AUTHORS)


@pytest.mark.parametrize(("tolerance", "want"), [(-4, True), (0, False), (2, False), (-1, True)])
def test_affiliation_window(spark, tolerance, want):
    r = authors(spark).where("author_id = 'a'").select(M.affiliation_match(F.col("affiliations"), F.lit("V"), F.lit(2021), tolerance)).first()
    assert r[0] is want


def test_a_country_counts_in_any_year(spark):
    got = {r["author_id"]: r["x"] for r in authors(spark).select("author_id", M.target_institutions(F.col("affiliations"), F.lit(2021), -4, "NL").alias("x")).collect()}
    assert got == {"a": ["V"], "b": [], "c": []}


def test_null_doi(spark):
    a = spark.createDataFrame([(1, None), (1, "x"), (2, "y")], "pair long, doi string")
    b = spark.createDataFrame([(1, None), (1, "x"), (2, None)], "pair long, doi string")
    assert M.shared_publications(a, b, ["pair"]).count() == 1
    assert M.shared_publications(a, b, ["pair"], MatchConfig(ignore_null_doi=False)).count() == 2


def test_result_has_a_placeholder_row(spark):
    theses = spark.createDataFrame([(42, "thesis:42", "U", "P", "T", 2020)], "integer_id long, thesis_identifier string, institution string, phd_name string, title string, year int")
    c = spark.createDataFrame([], "integer_id long, author_id string, display_name string, orcid string, api_rank int, affiliation_match boolean")
    w = spark.createDataFrame([], "integer_id long, author_id string, work_id string, title string, similarity double")
    best = M.best_candidate(M.candidate_evidence(c, w)).withColumn("n_name_search_matches", F.lit(0)).withColumn("phd_match_by", F.lit(None).cast("string"))
    none = "integer_id long, contributor_rank int"
    contributors = spark.createDataFrame([], f"{none}, contributor_name_source string, institution string")
    ev = M.contributor_evidence(contributors, spark.createDataFrame([], f"{none}, author_id string, display_name string, name_agrees boolean"), spark.createDataFrame([], f"{none}, institution string"), spark.createDataFrame([], f"{none}, doi string"), spark.createDataFrame([], none), spark.createDataFrame([], "author_id string"))
    out = M.assemble(theses, best, ev)
    rows = out.collect()
    assert tuple(out.columns) == RELATIONS and len(RELATIONS) == 34 and len(rows) == 1
    assert (rows[0]["integer_id"], rows[0]["thesis_identifier"], rows[0]["institution"], rows[0]["phd_name"], rows[0]["title_catalogue"], rows[0]["phd_id"]) == (42, "thesis:42", "U", "P", None, None)


def test_contributor_evidence_defaults_and_rules(spark):
    none = "integer_id long, contributor_rank int"
    contributors = spark.createDataFrame([(1, 1, "a", "U"), (1, 2, "b", "U"), (1, 3, "c", "U")], f"{none}, contributor_name_source string, institution string")
    candidates = spark.createDataFrame([(1, 1, "A1", "Ann", True), (1, 1, "A2", "Bob", False), (1, 2, "A3", "Cis", True)], f"{none}, author_id string, display_name string, name_agrees boolean")
    shared = spark.createDataFrame([(1, 1, "U"), (1, 1, "V")], f"{none}, institution string")
    pubs = spark.createDataFrame([(1, 2, "d1"), (1, 2, None)], f"{none}, doi string")
    co, pilot = spark.createDataFrame([(1, 2)], none), spark.createDataFrame([("A2",), ("A3",)], "author_id string")
    get = lambda config: {r["contributor_rank"]: r for r in M.contributor_evidence(contributors, candidates, shared, pubs, co, pilot, config).collect()}
    r = get(MatchConfig())
    assert (r[1]["contributor_confirmed"], r[1]["same_grad_inst"], r[1]["n_shared_inst_grad"], r[1]["contributor_id"], r[1]["name_matches_catalogue"], r[1]["is_sup_in_pilot_dataset"]) == (True, True, 2, ["A1", "A2"], ["Ann"], False)
    assert (r[2]["contributor_confirmed"], r[2]["sup_match_by"], r[2]["n_shared_pubs"], r[2]["is_thesis_coauthor"], r[2]["is_sup_in_pilot_dataset"]) == (False, "", 2, True, True)
    assert (r[3]["contributor_name"], r[3]["shared_pubs"], r[3]["n_shared_pubs"], r[3]["same_grad_inst"]) == ([], [], 0, False)
    assert get(MatchConfig(confirm_rule="shared_publication"))[2]["contributor_confirmed"]
    assert not get(MatchConfig(thesis_id_mode="legacy"))[2]["is_thesis_coauthor"]


def test_categories(spark):
    rows = [(None, None, None, None, None), ("x", None, True, True, True), ("x", "ranking", False, False, None), ("x", "ranking", False, False, True), ("x", "ranking", False, True, False), ("x", "ranking", False, True, True), ("x", "ranking", True, True, None), ("x", "ranking", True, True, True)]
    df = spark.createDataFrame(rows, "phd_id string, phd_match_by string, exact_match boolean, near_exact_match boolean, affiliation_match boolean")
    assert [r[0] for r in df.select(C.candidate_category()).collect()] == list(C.CANDIDATE_LABELS)
    got = R.histogram(df.limit(1).select(C.candidate_category().alias("category")), "category", C.CANDIDATE_LABELS).orderBy("position").collect()
    assert [r["n"] for r in got] == [1] + [0] * 7
    rows = [("", [], 1, True), ("r", [], 1, True), ("r", ["a"], 0, False), ("r", ["a"], None, True), ("r", ["a"], 2, None), ("r", ["a"], 2, True)]
    df = spark.createDataFrame(rows, "phd_match_by string, name_matches_catalogue array<string>, n_shared_pubs int, same_grad_inst boolean")
    assert [r[0] for r in df.select(C.contributor_category()).collect()] == list(C.CONTRIBUTOR_LABELS[:6])


def test_cosine_is_null_never_nan(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, None, None]


def test_title_similarity(spark):
    df = spark.createDataFrame([("A title!", "a title"), ("A title", None), ("--", "x"), ("deep nets", "shallow wells")], "t string, r string")
    got = {(r["t"]): r["similarity"] for r in ngram_similarity(df, "t", "r").collect()}
    assert got["A title!"] == pytest.approx(1.0) and got["A title"] is None and got["--"] is None and got["deep nets"] < 0.7


# --- relational and sampling ---------------------------------------------------------------------


def test_pivot_follows_row_order_and_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, None, "b", 0, 2), (1, None, "a", 1, 1), (2, "en", "c", 2, 1)], "id long, language string, contributor string, row_id long, contributor_order int")
    got = {r["id"]: r["contributors"] for r in R.group_to_list(df, ["id", "language"], "contributor", ["row_id"]).collect()}
    assert got == {1: ["b", "a"], 2: ["c"]}
    back = R.list_to_rows(R.group_to_list(df, ["id", "language"], "contributor", ["row_id"]), "contributors").collect()
    assert sorted((r["id"], r["contributor_rank"], r["contributor"]) for r in back) == [(1, 1, "b"), (1, 2, "a"), (2, 1, "c")]


def test_gaps_close_up_and_ten_is_the_limit(spark):
    df = spark.createDataFrame([([str(i) if i % 3 else None for i in range(20)],)], "c array<string>")
    assert df.select(R.first_n(F.col("c"), 10)).first()[0] == [str(i) for i in range(20) if i % 3][:10]


@pytest.mark.parametrize(("index", "want"), [(0, [0, 1, 2]), (2, [6]), (9, [6])])
def test_chunks(spark, index, want):
    df = spark.range(7).withColumnRenamed("id", "k").repartition(3)
    assert sorted(r["k"] for r in R.chunk(df, "k", 3, index).collect()) == want
    assert R.chunk(df.where("false"), "k", 3, index).count() == 0


def test_row_numbers_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 100003).alias("k"))
    got = R.row_numbers(df, "k", "n").orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1000))


def test_merge_near_duplicates(spark):
    df = spark.createDataFrame([(0, "a", "x"), (1, "a", None), (2, "a", "y"), (3, "a", "x"), (4, None, "z")], "row_id long, k string, v string")
    assert {r["k"]: r["v"] for r in R.merge_near_duplicates(df, "v", ["row_id"]).collect()} == {"a": ["x", "y"], None: ["z"]}


def test_lookup_passes_unknown_values(spark):
    df = spark.createDataFrame([("uu",), ("zz",), (None,)], "i string")
    assert [r[0] for r in R.lookup_or_self(df, "i", {"uu": "Utrecht"}).collect()] == ["Utrecht", "zz", None]
    assert R.lookup_or_self(df, "i", {}).count() == 3


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="domain"):
        R.equality_filter(spark.range(1), "domain", "x")
    assert R.equality_filter(spark.range(1), "domain", None).count() == 1


def test_samples(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert [r["k"] for r in S.sample_rows(df, 5, 1, "k").collect()] == [r["k"] for r in S.sample_rows(df.repartition(7), 5, 1, "k").collect()]
    assert S.sample_rows(df, 500, 1, "k").count() == 100
    bad = df.where("k % 2 = 0")
    out = S.sample_with_replacement_rows(df, bad, 20, F.col("k"), -F.col("k"), "k").orderBy("position").collect()
    assert [r["k"] for r in out] == [i if i % 2 else 99 - i for i in range(20)]
    assert S.sample_with_replacement_rows(df, df.where("k = 1000"), 5, F.col("k"), F.col("k"), "k").count() == 5
    with pytest.raises(ValueError, match="replaced"):
        S.sample_with_replacement_rows(df, df, 5, F.col("k"), F.col("k"), "k")
    import pandas as pd

    assert [r["k"] for r in S.numpy_sample(df, 7, 42, "k").orderBy("position").collect()] == pd.DataFrame({"k": range(100)}).sample(n=7, random_state=42)["k"].tolist()
