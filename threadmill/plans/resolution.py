"""Resolution from end to end: theses against a catalogue, to the 34-column result, its de-duplication and reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions import categories as C
from ..functions.names import first_last_udf
from ..operators import people as P
from ..operators import relational as R
from ..operators import resolution as M
from ..operators.similarity import ngram_similarity
from ..sources.files import read_through
from ..sources.lookup import name_to_id
from ..stages import cut


@dataclass(frozen=True)
class Catalogue:
    """authors, works, authorships as in ``schemas``; search: query_name, api_rank, author_id; pilot: author_id."""

    authors: DataFrame
    works: DataFrame
    authorships: DataFrame
    search: DataFrame
    pilot: DataFrame


def search_hits(names: DataFrame, catalogue: Catalogue) -> DataFrame:
    """(query_name, api_rank, author_id, display_name, orcid, affiliations, name_agrees) of each asked name.

    Keys of names are worked out once for each distinct name of either side.
    """
    asked = P.with_name_keys(names.select(F.col("name").alias("query_name")).distinct(), "query_name")
    found = asked.join(catalogue.search, "query_name").join(catalogue.authors, "author_id")
    keys = P.with_name_keys(catalogue.authors.select("display_name").distinct(), "display_name").select("display_name", F.col("initial").alias("_i"), F.col("components").alias("_c"))
    agrees = F.coalesce((F.col("initial") == F.col("_i")) & F.arrays_overlap("components", "_c"), F.lit(False))
    return found.join(keys, "display_name", "left").select("query_name", "api_rank", "author_id", "display_name", "orcid", "affiliations", agrees.alias("name_agrees"))


def title_similarity(rows: DataFrame) -> DataFrame:
    """The default encoder: (thesis, work) rows with the cosine of ``thesis_title`` and ``title``."""
    return ngram_similarity(rows, "title", "thesis_title")


def link_theses(pubs: DataFrame, catalogue: Catalogue, similarity: Callable[[DataFrame], DataFrame] = title_similarity, config: MatchConfig = MatchConfig()) -> DataFrame:
    """The result for each thesis of ``pubs`` and each of its first ten contributors.

    Contributors are looked at only where the PhD candidate is confirmed and has an institution in the
    target years. All candidates of a contributor whose names agree count together.
    """
    theses = pubs.select("integer_id", "thesis_identifier", "institution", "phd_name", "title", "year")
    listed = pubs.select("integer_id", "institution", "year", R.first_n(F.col("contributors"), config.max_contributors).alias("contributors"))
    contributors = R.list_to_rows(listed, "contributors", "contributor_name_source")
    names = theses.select(F.col("phd_name").alias("name")).unionByName(contributors.select(F.col("contributor_name_source").alias("name"))).where("name IS NOT NULL")
    hits = search_hits(names, catalogue)
    pairs = hits.where("name_agrees").select(F.col("query_name").alias("left_name"), F.col("display_name").alias("right_name")).distinct()
    best = cut(M.resolve_candidates(theses, catalogue.search, pairs, catalogue.authors, catalogue.authorships, catalogue.works, similarity, config))  # it goes into the rows and the evidence

    confirmed = best.where("phd_match_by IS NOT NULL").select("integer_id", F.col("author_id").alias("_phd"), F.get("work_ids", F.lit(0)).alias("_thesis"))
    own = catalogue.authors.select(F.col("author_id").alias("_phd"), F.col("affiliations").alias("_own"))
    mine = theses.select("integer_id", "year").join(confirmed, "integer_id").join(own, "_phd")
    mine = mine.withColumn("_at", M.target_institutions(F.col("_own"), F.col("year"), config.affiliation_tolerance)).where(F.size("_at") > 0).drop("_own", "year")
    asked = contributors.join(mine, "integer_id").join(hits, F.col("contributor_name_source") == F.col("query_name"))
    agreed = asked.where("name_agrees")
    keys = ["integer_id", "contributor_rank"]
    theirs = M.target_institutions(F.col("affiliations"), F.col("year"), config.affiliation_tolerance, config.country)
    shared = agreed.select(*keys, F.explode(F.array_intersect("_at", theirs)).alias("institution"))
    dois = catalogue.authorships.join(catalogue.works.select("work_id", "doi"), "work_id")
    left = agreed.select(*keys, "author_id", "_phd").join(dois.select(F.col("author_id").alias("_phd"), "doi"), "_phd").drop("_phd")
    pubs_ = M.shared_publications(left, dois, ["author_id"], config).select(*keys, "doi")
    coauthors = agreed.select(*keys, "author_id", F.col("_thesis").alias("work_id")).join(catalogue.authorships.withColumn("work_id", F.col("work_id").cast("string")), ["author_id", "work_id"], "left_semi").select(*keys)
    candidates = asked.select(*keys, "author_id", "display_name", "orcid", "name_agrees")
    evidence = M.contributor_evidence(contributors.select(*keys, "contributor_name_source", "institution"), candidates, shared, pubs_, coauthors, catalogue.pilot, config)
    return M.assemble(theses, best, evidence)


@dataclass(frozen=True)
class Reports:
    metrics: DataFrame
    candidates: DataFrame
    contributors: DataFrame
    not_found: DataFrame


def reports(pubs: DataFrame, relations: DataFrame, by: str = "phd_name") -> Reports:
    """Counts, both histograms and the theses whose candidate wasn't found."""
    once = relations.select("integer_id", "phd_id", "phd_match_by", "exact_match", "near_exact_match", "affiliation_match").distinct()
    return Reports(
        M.match_metrics(relations), R.histogram(once.select(C.candidate_category().alias("category")), "category", C.CANDIDATE_LABELS),
        R.histogram(relations.select(C.contributor_category().alias("category")), "category", C.CONTRIBUTOR_LABELS), M.not_found_export(pubs, relations, by),
    )


def pilot_map(supervisors: DataFrame, found: DataFrame, path: str) -> DataFrame:
    """(supervisor_name, supervisor_id), built once and then read: standardised names that the search knows by that very name.

    ``supervisors`` has a column of that singular name; ``found`` is the landed search for the names.
    """
    names = supervisors.select(first_last_udf("supervisor").alias("display_name")).where("display_name <> ''").distinct()
    build = lambda: names.join(name_to_id(found), "display_name").select(F.col("display_name").alias("supervisor_name"), F.col("author_id").alias("supervisor_id"))
    return read_through(supervisors.sparkSession, path, build)
