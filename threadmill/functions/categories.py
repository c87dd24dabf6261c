"""Match categories as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of candidates; the first two are not confirmed. Fixed values.
CANDIDATE_LABELS = (
    "Not found in catalogue",
    "Found, but no other match",
    "Fuzzy title match only",
    "Fuzzy title match + affiliation",
    "Near exact title match only",
    "Near exact title match + affiliation",
    "Exact title match only",
    "Exact title match + affiliation",
)
#: Labels of contributors; from the fifth on they are confirmed. Fixed values.
CONTRIBUTOR_LABELS = (
    "PhD not found in catalogue",
    "Contributor not found in catalogue",
    "No shared publications or affiliation at graduation",
    "Shared affiliation at graduation only",
    "Shared publications only",
    "Shared publications and affiliation at graduation",
    "Other",
)
FIRST_CONFIRMED_CANDIDATE, FIRST_CONFIRMED_CONTRIBUTOR = 2, 4


def _true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _absent(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def candidate_category() -> Column:
    """Of phd_id, phd_match_by, exact_match, near_exact_match, affiliation_match; nulls count as false."""
    fuzzy, fuzzy_aff, near, near_aff, exact, exact_aff = CANDIDATE_LABELS[2:]
    pick = lambda alone, both: F.when(_true("affiliation_match"), F.lit(both)).otherwise(F.lit(alone))
    return (
        F.when(F.col("phd_id").isNull(), CANDIDATE_LABELS[0]).when(_absent("phd_match_by"), CANDIDATE_LABELS[1])
        .when(_true("exact_match"), pick(exact, exact_aff)).when(_true("near_exact_match"), pick(near, near_aff)).otherwise(pick(fuzzy, fuzzy_aff))
    )


def contributor_category() -> Column:
    """Of phd_match_by, name_matches_catalogue (an array), n_shared_pubs, same_grad_inst."""
    pubs, same = F.coalesce(F.col("n_shared_pubs"), F.lit(0)) > 0, _true("same_grad_inst")
    return (
        F.when(_absent("phd_match_by"), CONTRIBUTOR_LABELS[0]).when(F.coalesce(F.size("name_matches_catalogue"), F.lit(0)) <= 0, CONTRIBUTOR_LABELS[1])
        .when(~pubs & ~same, CONTRIBUTOR_LABELS[2]).when(~pubs, CONTRIBUTOR_LABELS[3]).when(~same, CONTRIBUTOR_LABELS[4]).otherwise(CONTRIBUTOR_LABELS[5])
    )
