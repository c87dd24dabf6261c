"""Schemas of the engine's relations."""

from __future__ import annotations

PAIRS = "integer_id long, thesis_identifier string, contributor string, contributor_order int, institution string, author_name string, title string, year int, language string, row_id long"
PUBS = "integer_id long, thesis_identifier string, institution string, phd_name string, title string, year int, language string, contributors array<string>"
AUTHORS = "author_id string, display_name string, orcid string, affiliations array<struct<institution: struct<display_name: string, country_code: string>, years: array<int>>>"
WORKS = "work_id string, title string, doi string, publication_year int, type string"
AUTHORSHIPS = "author_id string, work_id string"
AUTHOR_SEARCH = "query_name string, api_rank int, author_id string"
PILOT = "supervisor_name string, supervisor_id string"
DUPLICATES = "array<struct<integer_id: long, thesis_identifier: string, institution: string, phd_name: string, phd_id: string>>"

#: Column order of the result of resolution. Fixed values.
RELATIONS = (
    "integer_id", "thesis_identifier", "institution", "phd_name", "phd_id", "phd_orcid", "n_name_search_matches", "duplicate_phds", "year", "title",
    "title_catalogue", "title_similarities", "max_title_similarity", "n_close_matches", "exact_match", "near_exact_match", "affiliation_match",
    "phd_match_score", "phd_match_by", "contributor_name_source", "name_matches_catalogue", "contributor_confirmed", "contributor_name",
    "contributor_id", "contributor_orcid", "sup_match_by", "contributor_rank", "same_grad_inst", "n_shared_inst_grad", "is_sup_in_pilot_dataset",
    "n_shared_pubs", "shared_pubs", "is_thesis_coauthor", "processing_error",
)
