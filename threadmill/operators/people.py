"""Telling persons from organisations, and matching names, set at a time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import WordLists
from ..functions import text
from ..functions.names import classify_udf, name_keys_udf, normalize_name, normalize_name_udf
from .relational import MAX_BROADCAST_ROWS, dimension


@dataclass(frozen=True)
class Classified:
    """accepted has the input's rows and columns; rejected and review count distinct names; all_rows has the decision."""

    accepted: DataFrame
    rejected: DataFrame
    review: DataFrame
    all_rows: DataFrame


def native_reason(name: Column, lists: WordLists) -> Column:
    """Reason of the rejecting rules, in their order, as an expression; null where none fits.

    Words are parted by anything that is no letter, digit or underscore, of any script.
    """
    words = F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    single = [w.lower() for w in ("and", *lists.words) if " " not in w]
    keyword = F.arrays_overlap(words, F.array(*[F.lit(w) for w in single])) | F.exists(words, lambda w: w.rlike("(?:" + "|".join(lists.endings) + ")$"))
    prefix = F.lower(name).rlike("^(?:" + "|".join(p.lower().replace("+", r"\+") for p in lists.prefixes) + ")")
    return (
        F.when((name == "") | (name == "--"), "empty_or_dash").when(prefix, "non_person_prefix").when(keyword, "org_keyword").when(name.rlike(r"\p{Nd}"), "contains_digit")
        .when((text.occurrences(name, ":/&+") >= 1) & (text.word_count(name) >= 3), "org_punctuation_pattern")
        .when(name.rlike(r"\b[A-Z]{2,}\b") & name.contains("(") & name.contains(")") & ~name.contains(","), "acronym_parenthesis_pattern")
        .when(name.rlike(r"\b[A-Z]{2,}(?:-[A-Z]{2,})+\b"), "acronym_dash_pattern").when(~name.rlike(r"\p{L}"), "no_letters")
    )


def classify_contributors(df: DataFrame, column: str = "contributor", lists: WordLists = WordLists(), whitelist: list[str] = (), blacklist: list[str] = (), accept_ambiguous: bool = False, strict_initials: bool = False) -> Classified:
    """Accept, reject or review each contributor; the lists win over the rules, the whitelist over the blacklist.

    Names are normalised and judged once for each distinct spelling and joined back. A null contributor
    is the text ``None``. Accepted ambiguous names keep the reason ``ambiguous`` and stay in the review.
    """
    raw = F.coalesce(F.col(column), F.lit("None"))
    spelled = df.select(raw.alias("_raw")).distinct().withColumn("contributor_normalized", normalize_name_udf("_raw"))
    ruled = spelled.withColumn("_r", classify_udf(lists, strict_initials)("contributor_normalized"))
    listed = {normalize_name(x): "blacklist" for x in blacklist} | {normalize_name(x): "whitelist" for x in whitelist}
    if listed:
        dim = dimension(df.sparkSession, listed, "_listed", "_list")
        dim = F.broadcast(dim) if len(listed) <= MAX_BROADCAST_ROWS else dim
        ruled = ruled.join(dim, F.col("contributor_normalized") == F.col("_listed"), "left").drop("_listed")
    else:
        ruled = ruled.withColumn("_list", F.lit(None).cast("string"))
    by_rule = F.when((F.col("_r.decision") == "review") & F.lit(accept_ambiguous), F.lit("accept")).otherwise(F.col("_r.decision"))
    decision = F.when(F.col("_list") == "whitelist", "accept").when(F.col("_list") == "blacklist", "reject").otherwise(by_rule)
    judged = ruled.select("_raw", "contributor_normalized", decision.alias("contributor_decision"), F.coalesce("_list", "_r.reason").alias("contributor_reason"))
    all_rows = df.join(judged, raw == judged["_raw"], "left").drop("_raw")
    extra = ["contributor_normalized", "contributor_decision", "contributor_reason"]
    summary = all_rows.groupBy(column, *extra).agg(F.count("*").alias("n_rows")).orderBy("contributor_decision", F.desc("n_rows"), column)
    return Classified(
        all_rows.where("contributor_decision = 'accept'").drop(*extra), summary.where("contributor_decision = 'reject'"),
        summary.where("contributor_reason = 'ambiguous'"), all_rows,
    )


def with_name_keys(df: DataFrame, column: str) -> DataFrame:
    """Add ``initial`` and ``components`` of a name column, worked out once for each distinct name."""
    keys = df.select(F.col(column).alias("_name")).where("_name IS NOT NULL").distinct().withColumn("_k", name_keys_udf("_name"))
    return df.join(keys, df[column] == keys["_name"], "left").select(*df.columns, F.col("_k.initial").alias("initial"), F.col("_k.components").alias("components"))


def name_match_join(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Distinct pairs of names with the same first initial and a surname component in common.

    An equi-join on (initial, component): it gives the very pairs that comparing all with all would.
    A component of many names is a hot key, which AQE can split.
    """
    sides = []
    for df, name, out in ((left, left_name, "left_name"), (right, right_name, "right_name")):
        names = df.select(F.col(name).alias(out)).where(F.col(out).isNotNull()).distinct()
        keyed = with_name_keys(names, out).where("initial IS NOT NULL")
        sides.append(keyed.select(out, "initial", F.explode("components").alias("component")))
    return sides[0].join(sides[1], ["initial", "component"]).select("left_name", "right_name").distinct()
