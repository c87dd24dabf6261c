"""License scan by ordered signature rules, in DataFrame functions only.

A text becomes its array of words (A-Z lower-cased, parted by every ASCII sign that is no letter or
digit). A rule runs in a row only if the row has all of the rule's keywords, which every match contains;
no other test stands before it. Each match becomes an interval of words. Where an interval lies within
another one of the same or a better tier, it is suppressed; of equal intervals the better tier, then
the earlier rule, stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clean_text, table
from .signatures import Rule, rules

#: Phrases whose places are counted in any case, and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Confidence by tier.
TIERS = {0: 1.0, 1: 0.95, 2: 0.8, 3: 0.6}
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_INTERVALS = "array<struct<start:int,back:int,tier:int,order:int,label:string>>"


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    lowered = F.translate(clean_text(text), _CAPITALS, _SMALL)
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def american(c: Column) -> Column:
    return F.replace(c, F.lit("licence"), F.lit("license"))


def _count(c: Column) -> Column:
    """How many words a piece of ``<word><word>`` has."""
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit("<"), F.lit("")))


def _intervals(tagged: Column, rule: Column) -> Column:
    """The matches of a rule as structs; ``rule`` is a struct of order, tier, label, needs and regex."""
    parts = F.split(F.regexp_replace(tagged, rule["regex"], F.lit("\u0001$0\u0002")), "\u0001")

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + _count(F.substring_index(part, "\u0002", 1))
        one = F.struct(acc["at"].alias("start"), (-end).alias("back"), rule["tier"].alias("tier"), rule["order"].alias("order"), rule["label"].alias("label"))
        return F.struct((acc["at"] + _count(part)).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    start = F.struct(_count(F.element_at(parts, 1)).alias("at"), F.array().cast(_INTERVALS).alias("out"))
    return F.aggregate(F.slice(parts, 2, F.size(parts)), start, step, lambda acc: acc["out"])


def _unsuppressed(found: Column) -> Column:
    """Sorted intervals without those that lie within one of the same or a better tier."""
    far = [f"e{t}" for t in TIERS]

    def step(acc: Column, x: Column) -> Column:
        end = -x["back"]
        reach = F.greatest(*[F.when(x["tier"] >= t, acc[far[t]]).otherwise(F.lit(-1)) for t in TIERS])
        return F.struct(
            *[F.when(x["tier"] == t, F.greatest(acc[far[t]], end)).otherwise(acc[far[t]]).alias(far[t]) for t in TIERS],
            F.when(reach >= end, acc["out"]).otherwise(F.concat(acc["out"], F.array(x))).alias("out"),
        )

    start = F.struct(*[F.lit(-1).alias(e) for e in far], F.array().cast(_INTERVALS).alias("out"))
    return F.aggregate(F.array_sort(found), start, step, lambda acc: acc["out"])


def _rule_map(table_: list[Rule]) -> Column:
    """Longest keyword -> its rules."""
    by_key: dict[str, list[Column]] = {}
    for r in table_:
        one = F.struct(F.lit(r.order).alias("order"), F.lit(r.tier).alias("tier"), F.lit(r.label).alias("label"), F.array(*map(F.lit, r.needs)).alias("needs"), F.lit(r.regex).alias("regex"))
        by_key.setdefault(r.needs[0], []).append(one)
    return F.create_map(*[x for key, own in by_key.items() for x in (F.lit(key), F.array(*own))])


def _base_places(words: Column) -> Column:
    """(start, label) of every place where a base phrase's words stand consecutively."""

    def here(word: Column, at: Column) -> Column:
        found = F.lit(None)
        for phrase, label in BASE_PHRASES:
            *before, last = phrase.split()
            fits = word == last
            for back, earlier in enumerate(reversed(before), 1):
                fits &= F.get(words, at - back) == earlier
            found = F.when(fits, F.struct((at - len(before)).cast("long").alias("start"), F.lit(label).alias("label"))).otherwise(found)
        return found

    lasts = F.array(*map(F.lit, sorted({phrase.split()[-1] for phrase, _ in BASE_PHRASES})))
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    return F.when(F.arrays_overlap(words, lasts), F.filter(F.transform(words, here), lambda x: x.isNotNull())).otherwise(none)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    ``detections`` are the intervals that stay (start word, end word, tier, label), in the order of their
    places. Null and empty texts have no words, null places, empty labels and score 0. Places are counted
    in words, so line ends and characters of any script change nothing. Of two rules that match the very
    same words the better tier, then the earlier rule, is named. Very long texts are scanned in whole:
    a rule is one pass over the text, with memory in proportion to it. Repeated rows are scanned one by
    one; a null id is carried along; other columns are ignored, whatever their names. An empty table
    gives no rows. No shuffle: each row is judged on its own.
    """
    table_ = rules()
    needed = sorted({w for r in table_ for w in r.needs})
    looked_for = F.array(*map(F.lit, dict.fromkeys(x for w in needed for x in (w, w.replace("license", "licence")))))
    split = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    keyed = split.select("doc_id", "words", F.array_distinct(F.transform(F.array_intersect("words", looked_for), american)).alias("keys"))
    by_key = _rule_map(table_)

    def run_rules(tagged: Column) -> Column:
        at_key = lambda key: F.coalesce(F.element_at(by_key, key), F.array().cast("array<struct<order:int,tier:int,label:string,needs:array<string>,regex:string>>"))
        open_ = F.filter(F.flatten(F.transform(F.col("keys"), at_key)), lambda rule: F.size(F.array_except(rule["needs"], F.col("keys"))) == 0)
        return F.flatten(F.transform(open_, lambda rule: _intervals(tagged, rule)))

    # the tagged text is bound once a row, as the one element of an array
    tagged = american(F.concat(F.lit("<"), F.array_join("words", "><"), F.lit(">")))
    found = F.when(F.size("keys") > 0, F.flatten(F.transform(F.array(tagged), run_rules)))
    ruled = keyed.select("doc_id", F.size("words").cast("long").alias("n_words"), _base_places(F.col("words")).alias("base"), found.alias("found"))
    kept = ruled.select("doc_id", "n_words", "base", F.when(F.size("found") > 0, _unsuppressed(F.col("found"))).otherwise(F.array().cast(_INTERVALS)).alias("kept"))
    certainty = F.create_map(*[F.lit(v) for kv in TIERS.items() for v in kv])
    confidence = F.coalesce(F.array_max(F.transform("kept", lambda x: F.element_at(certainty, x["tier"]))), F.lit(0.0))
    starts, base_labels = (F.transform("base", lambda x: x[c]) for c in ("start", "label"))
    return kept.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("kept", lambda x: x["label"])))), ",").alias("labels"),
        F.greatest(confidence, F.when(F.size("base") > 0, F.lit(TIERS[2])).otherwise(F.lit(0.0))).alias("score"),
        F.transform("kept", lambda x: F.struct(x["start"].alias("start_word"), (-x["back"]).alias("end_word"), x["tier"].alias("tier"), x["label"].alias("label"))).alias("detections"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql() -> str:
    values = ",\n  ".join(f"({r.order}, {r.tier}, {_quoted(r.label)}, {_quoted(r.needs[0])}, {_quoted(r.regex)})" for r in rules())
    phrases = " UNION ALL ".join(
        f"SELECT r, i - {len(p.split()) - 1} AS a, {_quoted(label)} AS label FROM places WHERE i >= {len(p.split()) - 1} AND " + " AND ".join(f"w[i + 1 - {back}] = {_quoted(word)}" for back, word in enumerate(reversed(p.split()))) for p, label in BASE_PHRASES
    )
    certainty = " ".join(f"WHEN {t} THEN {c}" for t, c in TIERS.items())
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT r, w, unnest(range(len(w))) AS i FROM d),
base AS ({phrases}),
based AS (SELECT r, count(*) AS n_base, min(a) AS first_word, max(a) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
rules(o, tier, label, key, re) AS (VALUES
  {values}),
tagged AS (SELECT r, replace('<' || array_to_string(w, '><') || '>', 'licence', 'license') AS s FROM d WHERE len(w) > 0),
parts AS (
  SELECT r, o, tier, label, string_split(regexp_replace(s, re, chr(1) || '\0' || chr(2), 'g'), chr(1)) AS p
  FROM tagged JOIN rules ON contains(s, '<' || key || '>') AND regexp_matches(s, re)),
counted AS (
  SELECT r, o, tier, label, list_transform(p, lambda x: len(x) - len(replace(x, '<', ''))) AS whole,
    list_transform(p, lambda x: len(split_part(x, chr(2), 1)) - len(replace(split_part(x, chr(2), 1), '<', ''))) AS own FROM parts),
hits AS (
  SELECT r, o, tier, label, list_sum(whole[:k])::BIGINT AS a, (list_sum(whole[:k]) + own[k + 1])::BIGINT AS z
  FROM (SELECT *, unnest(range(1, len(whole))) AS k FROM counted)),
kept AS (
  SELECT * FROM hits x WHERE NOT EXISTS (
    SELECT 1 FROM hits y WHERE y.r = x.r AND y.tier <= x.tier AND y.a <= x.a AND y.z >= x.z AND (y.a < x.a OR y.z > x.z OR y.tier < x.tier OR y.o < x.o))),
named AS (SELECT r, label FROM kept UNION SELECT r, label FROM base),
labelled AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM named GROUP BY r),
scored AS (SELECT r, max(CASE tier {certainty} END) AS score FROM kept GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  greatest(coalesce(score, 0), CASE WHEN n_base > 0 THEN {TIERS[2]} ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN based USING (r) LEFT JOIN labelled USING (r) LEFT JOIN scored USING (r)
"""


SQL = _sql()
