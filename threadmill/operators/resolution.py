"""Resolving people against a catalogue of authors and works, and the evidence between them.

All steps are joins and aggregates over long tables; every relation is keyed by ``integer_id``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import MatchConfig
from ..schemas import DUPLICATES, RELATIONS
from ..stages import remove, written


#: Lists of a candidate's works.
WORK_LISTS = ("titles", "work_ids", "title_similarities")


def _within(year: Column, base: Column, tolerance: int) -> Column:
    """A closed window on the side of the tolerance's sign; 0 is the year itself."""
    return year.between(base + min(tolerance, 0), base + max(tolerance, 0))


def works_in_window(df: DataFrame, work_year: str, year: str, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Works up to ``years_after`` behind the year, without a lower bound if there is none; a null year is out."""
    return df.where(_in_window(F.col(work_year), F.col(year), config))


def _in_window(work_year: Column, year: Column, config: MatchConfig) -> Column:
    keep = work_year <= year + config.years_after
    if config.years_before is not None:
        keep &= work_year >= year - config.years_before
    return keep


def affiliation_match(affiliations: Column, institution: Column, year: Column, tolerance: int) -> Column:
    """Whether an array of affiliations has the institution in a target year."""
    return F.coalesce(
        F.exists(affiliations, lambda a: (a["institution"]["display_name"] == institution) & F.exists(a["years"], lambda y: _within(y, year, tolerance))), F.lit(False)
    )


def target_institutions(affiliations: Column, year: Column, tolerance: int, country: str | None = None) -> Column:
    """Distinct institutions of the target years; none if a country is asked for and no affiliation of any year has it."""
    found = F.array_distinct(F.transform(
        F.filter(affiliations, lambda a: F.exists(a["years"], lambda y: _within(y, year, tolerance))), lambda a: a["institution"]["display_name"]
    ))
    found = F.coalesce(found, F.array().cast("array<string>"))
    if country is None:
        return found
    at_home = F.coalesce(F.exists(affiliations, lambda a: a["institution"]["country_code"] == country), F.lit(False))
    return F.when(at_home, found).otherwise(F.array().cast("array<string>"))


def tiers(similarity: Column, config: MatchConfig = MatchConfig()) -> dict[str, Column]:
    """Exact, near and close, nested; a null similarity is none of them."""
    bounds = {"exact_match": config.exact_similarity, "near_exact_match": config.near_similarity, "close_match": config.close_similarity}
    return {name: F.coalesce(similarity >= bound, F.lit(False)) for name, bound in bounds.items()}


def match_score(config: MatchConfig = MatchConfig()) -> Column:
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)).cast("int")
    return F.col("n_close_matches") + config.exact_weight * flag("exact_match") + config.near_weight * flag("near_exact_match") + config.affiliation_weight * flag("affiliation_match")


def _by_similarity(work_id: Column, title: Column, similarity: Column) -> Column:
    """What works are sorted by: from the most similar on, those that can't be compared last."""
    return F.struct(F.coalesce(-similarity, F.lit(2.0)).alias("_k"), work_id.alias("work_id"), title.alias("title"), similarity.alias("similarity"))


def _work_lists(collected: Column | None = None) -> list[Column]:
    """Titles, ids and similarities of works, from the most similar on: of an array of works, or as aggregates."""
    if collected is None:
        collected = F.collect_list(_by_similarity(F.col("work_id"), F.col("title"), F.col("similarity")))
    pairs = F.sort_array(collected)
    return [F.transform(pairs, lambda x: x["title"]).alias("titles"), F.transform(pairs, lambda x: x["work_id"].cast("string")).alias("work_ids"), F.transform(pairs, lambda x: x["similarity"]).alias("title_similarities")]


def candidate_evidence(candidates: DataFrame, works: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """One row per (integer_id, author_id) with what its works say.

    ``candidates`` has integer_id, author_id, api_rank, affiliation_match. ``works`` has integer_id,
    author_id, work_id, title, similarity: those in the window alone. Without works the best
    similarity is 0; if none can be compared it is null.
    """
    t = tiers(F.col("similarity"), config)
    by_work = works.groupBy("integer_id", "author_id").agg(
        F.max("similarity").alias("best"), F.count_if(t["close_match"]).cast("int").alias("n_close_matches"),
        *_work_lists(), F.lit(True).alias("has_works"),
    )
    return _scored(candidates.join(by_work, ["integer_id", "author_id"], "left"), config)


def _scored(joined: DataFrame, config: MatchConfig) -> DataFrame:
    """Add tiers and score to candidates with best, n_close_matches, has_works and the lists of works, which may be null."""
    best = F.when(F.col("has_works"), F.col("best")).otherwise(F.lit(0.0))
    b = tiers(F.col("max_similarity"), config)
    lists = {c: F.coalesce(c, F.array().cast(joined.schema[c].dataType)) for c in WORK_LISTS if c in joined.columns}
    return (
        joined.withColumn("max_similarity", best).withColumn("n_close_matches", F.coalesce("n_close_matches", F.lit(0)))
        .withColumn("exact_match", b["exact_match"]).withColumn("near_exact_match", b["near_exact_match"])
        .withColumns(lists).withColumn("match_score", match_score(config)).drop("best", "has_works")
    )


def best_candidate(evidence: DataFrame) -> DataFrame:
    """The candidate of each thesis with the best score, then similarity, then search rank."""
    order = Window.partitionBy("integer_id").orderBy(F.desc("match_score"), F.desc_nulls_last("max_similarity"), "api_rank", "author_id")
    return evidence.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at")


def resolve_candidates(theses: DataFrame, search: DataFrame, name_pairs: DataFrame, authors: DataFrame, authorships: DataFrame, works: DataFrame, similarity: Callable[[DataFrame], DataFrame], config: MatchConfig = MatchConfig(), lists: bool = True) -> DataFrame:
    """The best catalogue author of each thesis that has one whose name agrees.

    theses: integer_id, phd_name, title, year, institution. search: query_name, api_rank, author_id.
    name_pairs: left_name, right_name. ``similarity`` adds a column of that name to (thesis, work)
    rows. Names are joined first, works of the remaining candidates only, and years before similarity.
    Without ``lists`` the lists of its works are left to ``with_work_lists``.
    """
    candidates, candidates_at = written(_candidates(theses, search, name_pairs, authors, config).select(*_CARRIED, *_facts(authors)))
    compared = _compared(candidates, authorships, works, similarity, config)
    found = best_candidate(candidate_evidence(candidates, compared, config).drop(*WORK_LISTS))
    found, _ = written(found.withColumn("phd_match_by", F.when(F.col("match_score") > 0, F.lit("ranking"))))
    remove(theses.sparkSession, candidates_at)
    return with_work_lists(found, authorships, works, similarity, config) if lists else found


#: What is known of a candidate before its works are looked at.
_CARRIED = ["integer_id", "author_id", "api_rank", "n_name_search_matches", "thesis_title", "year", "affiliation_match"]


def _facts(authors: DataFrame) -> list[str]:
    """Columns of authors that their theses keep."""
    return [c for c in authors.columns if c not in ("author_id", "affiliations")]


def _candidates(theses: DataFrame, search: DataFrame, name_pairs: DataFrame, authors: DataFrame, config: MatchConfig) -> DataFrame:
    """The search hits of each thesis whose names agree, with the author's columns. Names are settled for each query, not for each of its theses."""
    if config.max_candidates is not None:
        search = search.where(F.col("api_rank") <= config.max_candidates)
    counts = search.groupBy("query_name").agg(F.count("*").alias("n_name_search_matches"))
    agreed = search.join(authors.select("author_id", "display_name"), "author_id").join(name_pairs, (F.col("query_name") == F.col("left_name")) & (F.col("display_name") == F.col("right_name")))
    known = agreed.select("query_name", "author_id", "api_rank").join(counts, "query_name").join(authors, "author_id")
    named = theses.withColumnRenamed("title", "thesis_title").join(known, F.col("phd_name") == F.col("query_name"))
    return named.withColumn("affiliation_match", affiliation_match(F.col("affiliations"), F.col("institution"), F.col("year"), config.affiliation_tolerance))


def works_by_author(authorships: DataFrame, works: DataFrame) -> DataFrame:
    """(author_id, works): the works of each author in one array."""
    return authorships.join(works, "work_id").groupBy("author_id").agg(F.collect_list(F.struct("work_id", "title", "publication_year")).alias("works"))


def resolve_by_author(theses: DataFrame, search: DataFrame, name_pairs: DataFrame, authors: DataFrame, held: DataFrame, compare: Callable[[DataFrame], DataFrame], config: MatchConfig = MatchConfig()) -> DataFrame:
    """As ``resolve_candidates`` without lists, where the similarity of a thesis and a work can be looked up: no row for each pair of them is made.

    ``held`` is that of ``works_by_author``; ``compare`` adds to rows with integer_id and ``works`` the array ``similarities`` of these works.
    All other columns of ``authors`` but the affiliations are kept.
    """
    candidates, candidates_at = written(_candidates(theses, search, name_pairs, authors, config).select(*_CARRIED))
    rows = _compared_works(candidates.join(authors.select("author_id", *_facts(authors)), "author_id"), held, compare, config)
    close = F.filter("_compared", lambda x: tiers(x["similarity"], config)["close_match"])
    rows = rows.withColumns({"best": F.array_max(F.transform("_compared", lambda x: x["similarity"])), "n_close_matches": F.size(close), "has_works": F.size("_compared") > 0})
    found, _ = written(best_candidate(_scored(rows.drop("_compared"), config)).withColumn("phd_match_by", F.when(F.col("match_score") > 0, F.lit("ranking"))))
    remove(theses.sparkSession, candidates_at)
    return found


def _compared_works(rows: DataFrame, held: DataFrame, compare: Callable[[DataFrame], DataFrame], config: MatchConfig) -> DataFrame:
    """Add ``_compared``, the works in the window as ``_by_similarity`` has them, to rows with integer_id, author_id and year; an empty array if there are none."""
    within = F.filter("works", lambda w: _in_window(w["publication_year"], F.col("year"), config))
    compared = compare(rows.join(held, "author_id", "left").withColumn("works", F.coalesce(within, F.filter("works", lambda w: F.lit(False)))))
    pairs = F.zip_with("works", "similarities", lambda w, s: _by_similarity(w["work_id"], w["title"], s))
    return compared.withColumn("_compared", F.coalesce(pairs, F.array())).drop("works", "similarities")


def with_held_lists(best: DataFrame, held: DataFrame, compare: Callable[[DataFrame], DataFrame], config: MatchConfig = MatchConfig()) -> DataFrame:
    """As ``with_work_lists``; lists are made where the author's works are, and are not moved."""
    rows = _compared_works(best, held, compare, config)
    return rows.withColumns(dict(zip(WORK_LISTS, _work_lists(F.col("_compared"))))).drop("_compared")


def _compared(candidates: DataFrame, authorships: DataFrame, works: DataFrame, similarity: Callable[[DataFrame], DataFrame], config: MatchConfig) -> DataFrame:
    """The works in the window of each (integer_id, author_id, thesis_title, year), with their similarity."""
    wide = candidates.select("integer_id", "author_id", "thesis_title", "year").join(authorships.join(works, "work_id"), "author_id")
    return similarity(works_in_window(wide, "publication_year", "year", config))


def with_work_lists(best: DataFrame, authorships: DataFrame, works: DataFrame, similarity: Callable[[DataFrame], DataFrame], config: MatchConfig = MatchConfig()) -> DataFrame:
    """The best candidates, one a thesis, with titles, ids and similarities of their works: lists of other candidates are never made."""
    compared = _compared(best, authorships, works, similarity, config)
    listed = compared.groupBy("integer_id", "author_id").agg(*_work_lists()).drop("author_id")
    empty = {c: F.coalesce(c, F.array().cast(listed.schema[c].dataType)) for c in ("titles", "work_ids", "title_similarities")}
    return best.join(listed, "integer_id", "left").withColumns(empty)


def shared_publications(left: DataFrame, right: DataFrame, on: list[str], config: MatchConfig = MatchConfig()) -> DataFrame:
    """Rows of ``left`` (pair columns, ``on`` among them, and doi) whose doi ``right`` (``on``, doi) has too.

    The right side stays one row per key and publication, however many pairs ask for it. A null DOI is
    no publication, unless ``ignore_null_doi`` is off: then it is one that all share.
    """
    a, b = left.distinct(), right.select(*on, "doi").distinct()
    if config.ignore_null_doi:
        return a.join(b, [*on, "doi"], "left_semi")
    b = b.select(*[F.col(c).alias(f"_{c}") for c in (*on, "doi")])
    same = a["doi"].eqNullSafe(b["_doi"])
    for c in on:
        same &= a[c] == b[f"_{c}"]
    return a.join(b, same, "left_semi")


def contributor_evidence(contributors: DataFrame, candidates: DataFrame, shared_affiliations: DataFrame, shared_pubs: DataFrame, coauthors: DataFrame, pilot: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """One row per (integer_id, contributor_rank): what the catalogue says of a contributor and the PhD candidate.

    contributors: integer_id, contributor_rank, contributor_name_source, institution. candidates:
    integer_id, contributor_rank, author_id, display_name, name_agrees (all search hits). The shared
    tables have integer_id, contributor_rank and institution / doi; coauthors has integer_id,
    contributor_rank; pilot has author_id; an orcid of candidates is optional. Contributors without evidence have the defaults.
    """
    keys = ["integer_id", "contributor_rank"]
    hits = candidate_lists(candidates, pilot, keys)
    affil = shared_affiliations.groupBy(*keys).agg(F.collect_set("institution").alias("_shared")).withColumn("n_shared_inst_grad", F.size("_shared"))
    pubs = shared_pubs.groupBy(*keys).agg(F.sort_array(F.collect_set("doi")).alias("shared_pubs"), F.max(F.col("doi").isNull().cast("int")).alias("_null"))
    pubs = pubs.withColumn("n_shared_pubs", F.size("shared_pubs") + F.col("_null")).drop("_null")
    return evidence_rows(contributors.join(hits, keys, "left").join(affil, keys, "left").join(pubs, keys, "left").join(coauthors.select(*keys).distinct().withColumn("_co", F.lit(True)), keys, "left"), config)


def candidate_lists(candidates: DataFrame, pilot: DataFrame, keys: list[str]) -> DataFrame:
    """What the search hits of each contributor are, in one row: ``keys`` name the contributor, or the name that was asked for."""
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("author_id", c))), lambda x: x[c])
    known = candidates.join(pilot.select("author_id").distinct().withColumn("_pilot", F.lit(True)), "author_id", "left")
    return known.groupBy(*keys).agg(
        ordered("display_name").alias("contributor_name"), F.sort_array(F.collect_list("author_id")).alias("contributor_id"),
        F.sort_array(F.collect_list(F.when(F.col("name_agrees"), F.col("display_name")))).alias("name_matches_catalogue"),
        F.bool_or(F.col("name_agrees") & F.coalesce("_pilot", F.lit(False))).alias("is_sup_in_pilot_dataset"),
        *([ordered("orcid").alias("contributor_orcid")] if "orcid" in candidates.columns else []),
    )


def evidence_rows(joined: DataFrame, config: MatchConfig = MatchConfig(), kept: Iterable[str] = ()) -> DataFrame:
    """The evidence of contributors: rows with the columns of ``candidate_lists``, n_shared_inst_grad, n_shared_pubs, shared_pubs, _shared and _co; nulls are defaults.

    A row without contributor_rank has no contributor, and no evidence. Columns named by ``kept`` are kept.
    """
    keys = ["integer_id", "contributor_rank"]
    strings = F.array().cast("array<string>")
    same = F.coalesce(F.array_contains("_shared", F.col("institution")), F.lit(False))
    n_aff, n_pub = (F.coalesce(c, F.lit(0)) for c in ("n_shared_inst_grad", "n_shared_pubs"))
    rules = {"shared_affiliation": n_aff > 0, "shared_publication": n_pub > 0, "same_grad_institution": same}
    confirmed = rules[config.confirm_rule]
    coauthor = F.coalesce("_co", F.lit(False)) if config.thesis_id_mode == "work_id" else F.lit(False)
    evidence = [
        *[F.coalesce(c, F.array().cast(joined.schema[c].dataType)).alias(c) for c in ("name_matches_catalogue", "contributor_name", "contributor_id", "contributor_orcid") if c in joined.columns],
        confirmed.alias("contributor_confirmed"), F.when(confirmed, F.lit(config.confirm_text)).otherwise(F.lit("")).alias("sup_match_by"), same.alias("same_grad_inst"),
        n_aff.alias("n_shared_inst_grad"), F.coalesce("is_sup_in_pilot_dataset", F.lit(False)).alias("is_sup_in_pilot_dataset"), n_pub.alias("n_shared_pubs"),
        F.coalesce(F.col("shared_pubs").cast("array<string>"), strings).alias("shared_pubs"), coauthor.alias("is_thesis_coauthor"),
    ]
    there = F.col("contributor_rank").isNotNull()
    rows = joined.select(*kept, *keys, "contributor_name_source", *evidence)
    return rows.withColumns({c: F.when(there, F.col(c)) for c in rows.columns[-len(evidence) :]})


def assemble(theses: DataFrame, best: DataFrame, evidence: DataFrame) -> DataFrame:
    """The 34 columns of the result: a row per contributor, or one placeholder row for a thesis without any.

    A found candidate names the PhD; a similarity of 0 and empty lists become null. In the placeholder
    row the catalogue titles are null, elsewhere the source title stands in for an empty list.
    """
    return result_rows(theses.join(best.select("integer_id", *found_columns()), "integer_id", "left").join(evidence, "integer_id", "left"))


def found_columns() -> list[Column]:
    """What the result has of the best candidate."""
    return [
        F.col("display_name").alias("_name"), F.col("author_id").alias("phd_id"), F.nullif("orcid", F.lit("")).alias("phd_orcid"), F.col("n_name_search_matches").cast("int").alias("n_name_search_matches"),
        F.col("titles").alias("_titles"), F.when(F.size("title_similarities") > 0, F.col("title_similarities")).alias("title_similarities"), F.nullif("max_similarity", F.lit(0.0)).alias("max_title_similarity"),
        "n_close_matches", "exact_match", "near_exact_match", "affiliation_match", F.col("match_score").alias("phd_match_score"), "phd_match_by",
    ]


def result_rows(rows: DataFrame) -> DataFrame:
    """The result of rows that have the columns of a thesis, ``found_columns`` and the evidence of a contributor, or nulls for it."""
    some = F.size("_titles") > 0
    titles = F.when(F.coalesce(some, F.lit(False)), F.col("_titles")).when(F.col("contributor_rank").isNotNull(), F.array("title"))
    rows = (
        rows.withColumn("phd_name", F.coalesce("_name", "phd_name")).withColumn("title_catalogue", titles).withColumn("duplicate_phds", F.lit(None).cast(DUPLICATES))
        .withColumn("processing_error", F.lit(None).cast("string"))
    )
    if "contributor_orcid" not in rows.columns:
        rows = rows.withColumn("contributor_orcid", F.when(F.col("contributor_rank").isNotNull(), F.array().cast("array<string>")))
    return rows.select(*RELATIONS)


def deduplicate_candidates(relations: DataFrame, order: str = "row_id") -> DataFrame:
    """Keep one thesis of those whose candidates are the same person, with all of them as diagnostics.

    Candidates are the same by ORCID, or by author id where there is none; without either they are no
    duplicates. The thesis with the most confirmed contributors stays, on a tie the first one by
    ``order``. ``duplicate_phds`` has the one that stays first, then the rest in input order.
    """
    records = ["integer_id", "thesis_identifier", "institution", "phd_name", "phd_id"]
    confirmed = F.coalesce(F.col("contributor_confirmed").cast("int"), F.lit(0))
    first = relations.groupBy("integer_id").agg(
        F.min_by(F.struct(*records[1:], "phd_orcid"), F.col(order)).alias("_f"), F.sum(confirmed).alias("_n"), F.min(order).alias("_first")
    ).select("integer_id", "_f.*", "_n", "_first")
    keyed = first.withColumn("_key", F.coalesce(F.nullif("phd_orcid", F.lit("")), F.nullif("phd_id", F.lit("")))).where("_key IS NOT NULL")
    kept = F.max_by("integer_id", F.struct("_n", -F.col("_first")))
    groups = keyed.groupBy("_key").agg(kept.alias("_kept"), F.count("*").alias("_size")).where("_size > 1")
    members = keyed.join(groups, "_key")
    removed = members.where("integer_id <> _kept").select("integer_id")
    record = F.struct(*records).alias("_rec")
    listed = F.sort_array(F.collect_list(F.struct((F.col("integer_id") != F.col("_kept")).alias("_gone"), "_first", record)))
    notes = members.groupBy("_kept").agg(F.transform(listed, lambda x: x["_rec"]).alias("_notes"))
    base = relations.drop("duplicate_phds").join(removed, "integer_id", "left_anti").join(notes, F.col("integer_id") == F.col("_kept"), "left")
    out = base.withColumn("duplicate_phds", F.col("_notes")).drop("_notes", "_kept")
    names = [c for c in relations.columns if c != "duplicate_phds"]
    at = names.index("n_name_search_matches") + 1 if "n_name_search_matches" in names else len(names)
    return out.select(*names[:at], "duplicate_phds", *names[at:])


def match_metrics(relations: DataFrame) -> DataFrame:
    """One row of counts over the result: theses, found, confirmed, contributors, shared publications, errors."""
    per_thesis = relations.groupBy("integer_id").agg(
        F.max(F.col("phd_id").isNotNull().cast("int")).alias("found"), F.max((F.coalesce("phd_match_by", F.lit("")) != "").cast("int")).alias("confirmed"),
        F.max(F.col("processing_error").isNotNull().cast("int")).alias("failed"), F.count("contributor_name_source").alias("n"),
        F.sum(F.coalesce(F.col("contributor_confirmed").cast("int"), F.lit(0))).alias("sup"), F.sum(F.coalesce("n_shared_pubs", F.lit(0))).alias("pubs"),
    )
    total = per_thesis.agg(
        F.count("*").alias("n_phds"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(o) for c, o in (("found", "n_found"), ("confirmed", "n_confirmed"), ("n", "n_contributors"), ("sup", "n_confirmed_contributors"), ("pubs", "n_shared_pubs"), ("failed", "n_failed"))]
    )
    return total.withColumn("percent_confirmed", F.round(100 * F.col("n_confirmed") / F.nullif("n_phds", F.lit(0)), 4))


def not_found_export(source: DataFrame, relations: DataFrame, by: str = "phd_name") -> DataFrame:
    """Rows of the source whose candidate wasn't found, joined by name (namesakes too) or by another key."""
    missing = relations.where("phd_id IS NULL").select(by).distinct()
    return source.join(missing, by, "left_semi").select(*source.columns)
