"""Cleaning from end to end: pairs to one row per thesis, and the sample for labelling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CleanConfig, WordLists
from ..functions.names import first_last_udf
from ..operators import people as P
from ..operators import relational as R
from ..operators import sampling as S

_KEYS = ["integer_id", "thesis_identifier", "institution", "author_name", "title", "year", "language"]


@dataclass(frozen=True)
class Cleaned:
    pubs: DataFrame
    pubs_raw: DataFrame
    classified: P.Classified


def pivot_pubs(pairs: DataFrame, rank_by: str = "row_id") -> DataFrame:
    """One row per thesis with its contributors in file order (or another order that is asked for)."""
    order = [rank_by] if rank_by == "row_id" else [rank_by, "row_id"]
    return R.group_to_list(pairs, _KEYS, "contributor", order).withColumnRenamed("author_name", "phd_name")


def clean_pairs(pairs: DataFrame, config: CleanConfig = CleanConfig(), lists: WordLists = WordLists(), whitelist: list[str] = (), blacklist: list[str] = ()) -> Cleaned:
    """Filter years and nulls, drop repeated rows, keep persons, standardise names and pivot.

    The cheap filters come first: the rules are Python and run on distinct names. Of repeated rows the
    first one stays. Accepted rows keep their spelling until names are standardised.
    """
    rest = [c for c in pairs.columns if c != "row_id"]
    kept = R.drop_null_keys(R.year_range(pairs, "year", config.first_year, config.last_year), "contributor")
    kept = kept.groupBy(*rest).agg(F.min("row_id").alias("row_id"))
    classified = P.classify_contributors(kept, "contributor", lists, whitelist, blacklist, config.accept_ambiguous, config.strict_initials)
    standard = classified.accepted.withColumn("contributor", first_last_udf("contributor")).withColumn("author_name", first_last_udf("author_name"))
    return Cleaned(pivot_pubs(standard, config.rank_by), pivot_pubs(kept, config.rank_by), classified)


def labelling_sample(cleaned: Cleaned, excluded_ids: DataFrame, config: CleanConfig = CleanConfig()) -> tuple[DataFrame, DataFrame]:
    """A sample of raw rows and the cleaned rows in the same order, null where cleaning left none."""
    raw = cleaned.pubs_raw
    sample = S.sample_with_replacement_rows(raw, excluded_ids, config.sample_rows, S.hash_order("integer_id", config.sample_seed), S.hash_order("integer_id", config.replacement_seed), "integer_id")
    return sample, R.align_to(sample, cleaned.pubs, "integer_id", "position")
