"""Rules of names, table-driven."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadmill.config import WordLists
from threadmill.functions import names as N
from threadmill.functions import text as X
from threadmill.operators import people as P

LISTS = WordLists()


@pytest.mark.parametrize(("raw", "want"), [
    (None, None), ("  Jan  Jansen ", "Jan Jansen"), ('"Jan"', "Jan"), ("[ No Value ]", ""), ("Supervisor: A. B", "A. B"), ("P.C.. Vos†‡*", "P.C. Vos"),
    ('honkim"aki', "honkimäki"), ("M ́enard", "Ménard"), ("Rottsch¨afer", "Rottschäfer"), ("Sj°astad", "Sjåstad"), ("Pe˜na", "Peña"), ("A – B — C ‐ D", "A - B - C - D"),
    ("Vos , A.,,B", "Vos, A., B"), (", Vos ,", "Vos"), ("ﬁn", "fin"),
])
def test_normalize(raw, want):
    assert N.normalize_name(raw) == want


@pytest.mark.parametrize(("name", "want"), [
    ("", ("reject", "empty_or_dash")), ("--", ("reject", "empty_or_dash")), ("Department of X", ("reject", "non_person_prefix")), ("Jan and Piet", ("reject", "org_keyword")),
    ("Applied Geology", ("reject", "org_keyword")), ("Jan 2", ("reject", "contains_digit")), ("Big / Small Things", ("reject", "org_punctuation_pattern")), ("XYZ (north)", ("reject", "acronym_parenthesis_pattern")),
    ("ITC-EOS", ("reject", "acronym_dash_pattern")), ("...", ("reject", "no_letters")), ("van der Heide, Tjisse", ("accept", "person_pattern")), ("Gier, de, Han", ("accept", "person_pattern")),
    ("Wit, G.A. de", ("accept", "person_pattern")), ("P.C. Struik", ("accept", "person_pattern")), ("Nel Wognum", ("accept", "person_pattern")), ("j jansen", ("accept", "person_pattern")),
    ("P. @@ x", ("accept", "person_pattern")), ("Madonna", ("review", "ambiguous")),
])
def test_classify(name, want):
    assert N.classify_name(name, N.build_grammar(LISTS)) == want


def test_strict_initials_anchor_the_form():
    assert N.classify_name("P. @@ x", N.build_grammar(LISTS, strict_initials=True)) == ("review", "ambiguous")


@pytest.mark.parametrize(("name", "want"), [
    ("van der Heide, Tjisse", "Tjisse van der Heide"), ("Prof. dr. J. van Dijk", "J. van Dijk"), ("Wit, G.A. de", "G.A. de Wit"), ("Gier, de, Han", "Han de Gier"),
    ("Jones, Anna B., PhD", "Anna B. Jones"), ("Anna (Annie) Jones", "Anna Jones"), ("Bob", "Bob"), (None, None), ("Jan  de   Vries", "Jan de Vries"),
])
def test_first_last(name, want):
    assert N.first_last(name) == want


@pytest.mark.parametrize(("a", "b", "want"), [
    ("Anna Smith-Jones", "A. Jones", True), ("Anna Smith-Jones", "A. Smith", True), ("Anna Smith", "B. Smith", False), ("Jan van Dijk", "J. Dijk", True), ("Élise Müller", "E. Muller", True),
    ("Bob", "Bob", False), ("A. Jones‑Smith", "A. Smith", False), ("A Jones−Smith", "A. Smith", True),
])
def test_names_agree(a, b, want):
    assert N.names_agree(a, b) is want
    assert N.names_agree(b, a) is want


def test_a_non_breaking_hyphen_is_a_dash_if_asked():
    assert N.name_keys("A. Jones‑Smith", dash_2011=True)[1] == ("JONES", "SMITH")


_NAMES = st.builds(lambda f, d, l: f"{f}{d}{l}", st.sampled_from(["A.", "Anna", "B", "Émile", ""]), st.sampled_from([" ", " van ", " x "]), st.sampled_from(["Smith", "Smith-Jones", "Jones", "Müller", "Muller – Jones", ""]))


@settings(max_examples=8, deadline=None)
@given(st.lists(_NAMES, min_size=1, max_size=12), st.lists(_NAMES, min_size=1, max_size=12))
def test_block_join_equals_all_pairs(spark, a, b):
    left, right = (spark.createDataFrame([(x,) for x in v], "n string") for v in (a, b))
    got = {tuple(r) for r in P.name_match_join(left, right, "n", "n").collect()}
    assert got == {(x, y) for x in a for y in b if N.names_agree(x, y)}


def test_native_normal_form_agrees_on_ascii(spark):
    raw = ["  a  b ", "'x'", "Supervisor: A", "P.C.. V", "a ,b,, c", "[ no value ]x", "x**", ", y ,", "", "a.\n b"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "n string").select(X.normalize_name_native(F.col("n"))).collect()]
    assert got == [N.normalize_name(x) for x in raw]


def test_classification_is_a_partition_and_lists_win(spark):
    rows = [("Jan Jansen",), ("University of X",), ("Madonna",), ("Cher",), (None,), ("Jan Jansen",), ("Lab Both",)]
    df = spark.createDataFrame(rows, "contributor string").withColumn("row_id", F.monotonically_increasing_id())
    c = P.classify_contributors(df, whitelist=["Cher", "Lab Both"], blacklist=["Jan Jansen", "Lab Both"])
    got = {r["contributor"]: (r["contributor_decision"], r["contributor_reason"]) for r in c.all_rows.collect()}
    assert got["Cher"] == got["Lab Both"] == ("accept", "whitelist") and got["Jan Jansen"] == ("reject", "blacklist")
    assert got["University of X"][0] == "reject" and got["Madonna"] == got[None] == ("review", "ambiguous")
    assert c.all_rows.count() == 7 and c.accepted.columns == df.columns
    assert {(r["contributor"], r["n_rows"]) for r in c.rejected.collect()} == {("Jan Jansen", 2), ("University of X", 1)}
    loose = P.classify_contributors(df, accept_ambiguous=True)
    assert loose.accepted.where("contributor = 'Madonna'").count() == 1 and loose.review.where("contributor = 'Madonna'").count() == 1


@pytest.mark.parametrize(("n", "want"), [(1, "1st"), (2, "2nd"), (3, "3rd"), (4, "4th"), (11, "11th"), (12, "12th"), (13, "13th"), (21, "21st"), (111, "111th"), (0, "0th")])
def test_ordinal(spark, n, want):
    assert spark.range(1).select(X.ordinal(F.lit(n))).first()[0] == want
