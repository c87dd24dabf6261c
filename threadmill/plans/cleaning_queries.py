"""Queries of cleaning: filters, de-duplication, pivots, samples, names and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..config import WordLists
from ..functions import text as X
from ..functions.names import first_last_udf, normalize_name_udf
from ..operators import people as P
from ..operators import relational as R
from ..operators import sampling as S
from ..sources import service
from .tables import LINE_ORDER, NAME_FORMS, name_forms, pairs, table, text_lines

_ORDER_SQL = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
_PAIRS = f"""pairs AS (
  SELECT o_orderkey AS integer_id, year(o_orderdate)::INT AS year, s_name AS contributor, {_ORDER_SQL}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"""
_PUBS = f"""{_PAIRS}, pubs AS (
  SELECT integer_id, year, list(contributor ORDER BY {_ORDER_SQL}) AS contributors FROM pairs GROUP BY integer_id, year)"""


def _pubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.group_to_list(pairs(spark, sf_dir), ["integer_id", "year"], "contributor", LINE_ORDER)


@query("SELECT o_orderkey, year(o_orderdate)::INT AS year FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND nullif(o_orderpriority, '5-LOW') IS NOT NULL")
def year_range_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("key"))
    return R.drop_null_keys(R.year_range(orders, "year", 1996, 1998), "key").drop("key")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def equality_filter(spark, sf_dir):
    return R.equality_filter(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "BUILDING")


@query("SELECT DISTINCT l_returnflag, l_linestatus, nullif(l_linenumber, 1) AS line FROM lineitem")
def distinct_rows(spark, sf_dir):
    return R.distinct_rows(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.nullif("l_linenumber", F.lit(1)).alias("line")))


@query(f"SELECT l_orderkey, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER_SQL}) AS k FROM lineitem) WHERE k = 1")
def distinct_keep_first(spark, sf_dir):
    return R.keep_first(table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER), ["l_orderkey"], LINE_ORDER).select("l_orderkey", "l_partkey", "l_suppkey")


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
def duplicates_keep_all(spark, sf_dir):
    return R.keep_duplicates(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest")), ["digest"])


@query(f"WITH {_PUBS} SELECT integer_id, year, array_to_string(contributors, '|') AS contributors, len(contributors)::INT AS n, contributors[1] AS contributor_1, contributors[2] AS contributor_2, contributors[3] AS contributor_3 FROM pubs")
def contributor_pivot(spark, sf_dir):
    wide = R.spread_list(_pubs(spark, sf_dir), "contributors", 3)
    return wide.select("integer_id", "year", F.array_join("contributors", "|").alias("contributors"), F.size("contributors").alias("n"), "contributor_1", "contributor_2", "contributor_3")


@query(f"WITH {_PUBS} SELECT integer_id, year, len(contributors)::INT AS contributor_count, year(DATE '2000-01-01') > year AS early FROM pubs WHERE len(contributors) >= 4")
def contributor_count_flag(spark, sf_dir):
    count = F.size(F.filter("contributors", lambda x: x.isNotNull()))
    counted = _pubs(spark, sf_dir).select("integer_id", "year", count.alias("contributor_count"))
    return counted.where("contributor_count >= 4").withColumn("early", F.lit(2000) > F.col("year")).orderBy("year", "contributor_count", "integer_id")


@query(f"WITH {_PUBS} SELECT integer_id, array_to_string(contributors[1:3], '|') AS kept FROM pubs")
def rank_cutoff(spark, sf_dir):
    return R.null_out_beyond(_pubs(spark, sf_dir), "contributors", 3).select("integer_id", F.array_join("contributors", "|").alias("kept"))


@query(f"WITH {_PUBS} SELECT integer_id, contributor_rank::INT AS contributor_rank, contributors[contributor_rank] AS contributor FROM (SELECT *, unnest(range(1, least(len(contributors), 10) + 1)) AS contributor_rank FROM pubs)")
def unpivot_contributors(spark, sf_dir):
    pubs = _pubs(spark, sf_dir).select("integer_id", R.first_n(F.col("contributors"), 10).alias("contributors"))
    return R.list_to_rows(pubs, "contributors")


_INSTITUTIONS = {"NATION_1": "First University", "NATION_2": "Second University", "NATION_3": "Third Institute"}


@query("SELECT n_nationkey, coalesce(CASE n_name WHEN 'NATION_1' THEN 'First University' WHEN 'NATION_2' THEN 'Second University' WHEN 'NATION_3' THEN 'Third Institute' END, n_name) AS n_name FROM nation")
def lookup_coalesce(spark, sf_dir):
    return R.lookup_or_self(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_name", _INSTITUTIONS)


def _large_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_members(spark, sf_dir):
    return R.members(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), _large_orders(spark, sf_dir), "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def anti_members(spark, sf_dir):
    return R.members(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), _large_orders(spark, sf_dir), "c_custkey", present=False)


_KEY = "(c_custkey * 7919) % 100003"


@query(f"WITH base AS (SELECT c_custkey FROM customer ORDER BY {_KEY}, c_custkey LIMIT 50) SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM base) AND c_custkey % 7 <> 0")
def replacement_pool(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    base = S.top_by_order(customers, F.expr(_KEY), "c_custkey", 50)
    unwanted = customers.where("c_custkey % 7 = 0")
    return R.members(R.members(customers, unwanted, "c_custkey", present=False), base, "c_custkey", present=False)


@query(f"""WITH base AS (SELECT c_custkey, row_number() OVER (ORDER BY {_KEY}, c_custkey) - 1 AS position FROM customer QUALIFY position < 50)
SELECT position, b.c_custkey, c_name FROM base b LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c USING (c_custkey)""")
def ordered_left_reindex(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    sample = S.top_by_order(customers.select("c_custkey"), F.expr(_KEY), "c_custkey", 50)
    return R.align_to(sample, customers.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name"), "c_custkey", "position")


@query("SELECT c_custkey, c_name FROM (SELECT *, (row_number() OVER (ORDER BY c_custkey) - 1) // 40 AS chunk FROM customer) WHERE chunk = least(2, (SELECT (count(*) - 1) // 40 FROM customer))")
def chunk_select(spark, sf_dir):
    return R.chunk(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 40, 2)


@query(f"SELECT c_custkey, row_number() OVER (ORDER BY {_KEY}, c_custkey) - 1 AS position FROM customer QUALIFY position < 50")
def ordered_sample(spark, sf_dir):
    return S.top_by_order(table(spark, sf_dir, "customer").select("c_custkey"), F.expr(_KEY), "c_custkey", 50)


@query("SELECT c_custkey, c_name, row_number() OVER (ORDER BY md5(c_custkey || ':12'), c_custkey) - 1 AS position FROM customer QUALIFY position < 50")
def hash_sample(spark, sf_dir):
    return S.sample_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 50, 12, "c_custkey")


@query(f"""WITH base AS (SELECT c_custkey, row_number() OVER (ORDER BY {_KEY}, c_custkey) - 1 AS position FROM customer QUALIFY position < 50),
holes AS (SELECT position, row_number() OVER (ORDER BY position) AS k FROM base WHERE c_custkey % 7 = 0),
pool AS (SELECT c_custkey, row_number() OVER (ORDER BY (c_custkey * 104729) % 100003, c_custkey) AS k FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey NOT IN (SELECT c_custkey FROM base))
SELECT c_custkey, position FROM base WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, position FROM holes JOIN pool USING (k)""")
def sample_with_replacement(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return S.sample_with_replacement_rows(customers, customers.where("c_custkey % 7 = 0"), 50, F.expr(_KEY), F.expr("(c_custkey * 104729) % 100003"), "c_custkey")


@query()
def numpy_sample(spark, sf_dir):
    return S.numpy_sample(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 50, 42, "c_custkey")


@query("SELECT l_returnflag, l_linestatus, nullif(l_linenumber, 1) AS line, count(*) AS n_rows FROM lineitem GROUP BY ALL")
def summary_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.nullif("l_linenumber", F.lit(1)).alias("line"))
    return R.row_counts(lines, lines.columns).orderBy("l_returnflag", F.desc("n_rows"), "l_linestatus", "line")


@query("""SELECT o_custkey, o_orderstatus, array_to_string(list(p ORDER BY k), '|') AS o_orderpriority FROM (
  SELECT o_custkey, o_orderstatus, o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY ALL) GROUP BY ALL""")
def near_duplicate_merge(spark, sf_dir):
    merged = R.merge_near_duplicates(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderpriority", ["o_orderkey"])
    return merged.select("o_custkey", "o_orderstatus", F.array_join("o_orderpriority", "|").alias("o_orderpriority"))


_LETTERS = r"regexp_replace(strip_accents(replace({}, 'ß', 'ss')), '[^\p{{L}}]', '', 'g')"
_NAMES = "names AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS f, split_part(p_name, ' ', 2) AS l FROM part WHERE contains(p_name, ' '))"


def _forms_sql(pick) -> str:
    """The rows of all spellings, with what ``pick`` says of a form as SQL columns."""
    return f"WITH {_NAMES} " + " UNION ".join(f"SELECT {form} AS name, {pick(*rest)} FROM names" for form, *rest in NAME_FORMS)


@query(_forms_sql(lambda formatted, initial, components: f"upper(left({initial}, 1)) AS initial, array_to_string(list_transform(string_split({components}, '|'), lambda x: upper({_LETTERS.format('x')})), '|') AS components"))
def name_components(spark, sf_dir):
    return P.with_name_keys(name_forms(spark, sf_dir), "name").select("name", "initial", F.array_join("components", "|").alias("components"))


@query("""WITH n AS (SELECT DISTINCT p_name AS full_name, left(p_name, 1) || '. ' || split_part(p_name, ' ', 2) AS short FROM part)
SELECT DISTINCT a.short AS left_name, b.full_name AS right_name FROM n a, n b
WHERE upper(left(a.short, 1)) = upper(left(b.full_name, 1)) AND upper(split_part(a.short, ' ', 2)) = upper(split_part(b.full_name, ' ', 2))""")
def name_block_join(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    short = names.select(F.concat(F.substring("p_name", 1, 1), F.lit(". "), F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))).alias("short"))
    return P.name_match_join(short, names, "short", "p_name")


@query()
def name_block_join_documents(spark, sf_dir):
    """Every line of every whole document against every line of the benchmark and every name."""
    lines = text_lines(spark, sf_dir)
    known = text_lines(spark, sf_dir, "benchmark", "item_id").select("name").unionByName(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))
    return P.name_match_join(lines, known, "name", "name")


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  text, '(?i)\[\s*No Value\s*\]', '', 'g'), '^\s+|\s+$', '', 'g'), '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g'), '[†‡*⁎⁑§¶‖¤※]+', '', 'g'),
  '[–—‐]', '-', 'g'), '\.\.+', '.', 'g'), '\s+', ' ', 'g'), '\s*,\s*', ', ', 'g'), '(?:,\s*){2,}', ', ', 'g'), ' ,') AS name
FROM (SELECT doc_id, replace(text, 'Supervisor:', '') AS text FROM documents)""")
def name_normalize_ascii(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize_name_native(F.col("text")).alias("name"))


_LATIN_SQL = "A-Za-zÀ-ÖØ-öø-ÿĀ-ž"
#: The steps of normalisation after the composing of characters, as (pattern, replacement).
_STEPS = [
    (r"(?i)\[\s*No Value\s*\]", ""), (r"^\s+|\s+$", ""), ('^"+|"+$', ""), ("^''+|''+$", ""), ("Supervisor:", ""), ("[†‡*⁎⁑§¶‖¤※]", ""),
    ('"', "̈"), ("¨", "̈"), ("´", "́"), ("`", "̀"), ("ˆ", "̂"), ("˜", "̃"), ("°", "̊"), ("¸", "̧"),
    (rf"\s*([̀-ͯ]+)\s*([{_LATIN_SQL}])", r"\2\1"), (rf"([{_LATIN_SQL}])\s+([̀-ͯ]+)", r"\1\2"),
]
_LAST_STEPS = [("[–—‐]", "-"), (r"\.\.+", "."), (r"\s+", " "), (r"\s*,\s*", ", "), (r"(?:,\s*){2,}", ", "), ("^[ ,]+|[ ,]+$", "")]


def _nested(inner: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        inner = f"regexp_replace({inner}, '{pattern}', '{to}', 'g')"
    return inner


@query(f"WITH t AS (SELECT text AS name FROM documents UNION ALL SELECT * FROM (SELECT DISTINCT p_name FROM part)) SELECT name, {_nested(f'nfc_normalize({_nested("nfc_normalize(name)", _STEPS)})', _LAST_STEPS)} AS normalized FROM t")
def name_normalize_full(spark, sf_dir):
    """One row a document, whole, and one a distinct name."""
    texts = table(spark, sf_dir, "documents").select(F.col("text").alias("name"))
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return texts.unionByName(names).withColumn("normalized", normalize_name_udf("name"))


_LISTS = WordLists(words=("department", "university", "institute", "research"), prefixes=("customer#0", "blue "), endings=("ology", "get"))


def _named(spark, sf_dir) -> DataFrame:
    """Contributors of the tables of names: part, customer and supplier names, and all spellings of part names."""
    people = table(spark, sf_dir, "part").select(F.col("p_name").alias("contributor"))
    others = table(spark, sf_dir, "customer").select(F.col("c_name").alias("contributor")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("contributor")))
    return people.unionByName(others).unionByName(name_forms(spark, sf_dir).select(F.col("name").alias("contributor")))


_NAMED_SQL = f"c0 AS (SELECT p_name AS s FROM part UNION ALL SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT * FROM ({' UNION '.join(f'SELECT {form} FROM names' for form, *_ in NAME_FORMS)}))"
_REASON_SQL = r"""CASE WHEN s IN ('', '--') THEN 'empty_or_dash' WHEN starts_with(lower(s), 'customer#0') OR starts_with(lower(s), 'blue ') THEN 'non_person_prefix'
  WHEN len(list_filter(string_split_regex(lower(s), '[^\p{L}\p{N}_]+'), lambda w: w IN ('and', 'department', 'university', 'institute', 'research') OR ends_with(w, 'ology') OR ends_with(w, 'get'))) > 0 THEN 'org_keyword'
  WHEN regexp_matches(s, '\p{Nd}') THEN 'contains_digit' WHEN regexp_matches(s, '[:/&+]') AND len(string_split(s, ' ')) >= 3 THEN 'org_punctuation_pattern'
  WHEN regexp_matches(s, '\b[A-Z]{2,}\b') AND contains(s, '(') AND contains(s, ')') AND NOT contains(s, ',') THEN 'acronym_parenthesis_pattern'
  WHEN regexp_matches(s, '\b[A-Z]{2,}(?:-[A-Z]{2,})+\b') THEN 'acronym_dash_pattern' WHEN NOT regexp_matches(s, '\p{L}') THEN 'no_letters' ELSE 'none' END"""
_RULES_SQL = rf"""WITH {_NAMES}, {_NAMED_SQL}, c AS (SELECT s FROM c0 UNION ALL SELECT s FROM (
  SELECT trim(regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS s FROM documents) WHERE s <> ''),
r AS (SELECT s, {_REASON_SQL} AS reason FROM c)
SELECT s AS contributor, reason, count(*) AS n_rows FROM r GROUP BY ALL"""
_JUDGED_SQL = rf"""WITH {_NAMES}, {_NAMED_SQL}, r AS (SELECT s, {_REASON_SQL} AS why FROM c0),
p AS (SELECT *, regexp_matches(s, '^[\p{{L}}.''-]+( [\p{{L}}.''-]+)+$') OR regexp_matches(s, '^[\p{{L}}.''-]+( [\p{{L}}.''-]+)*(, [\p{{L}}.''-]+( [\p{{L}}.''-]+)*)$') OR regexp_matches(s, '^[\p{{L}}][.]') AS person FROM r),
judged AS (SELECT s AS contributor, s AS contributor_normalized, CASE WHEN why <> 'none' THEN 'reject' WHEN person THEN 'accept' ELSE 'review' END AS decision, CASE WHEN why <> 'none' THEN why WHEN person THEN 'person_pattern' ELSE 'ambiguous' END AS reason FROM p)"""


@query(_RULES_SQL)
def classify_rules(spark, sf_dir):
    """Names, and every line of every document."""
    contributors = _named(spark, sf_dir).unionByName(text_lines(spark, sf_dir).select(F.col("name").alias("contributor")))
    reason = F.coalesce(P.native_reason(F.col("contributor"), _LISTS), F.lit("none"))
    return R.row_counts(contributors.select("contributor", reason.alias("reason")), ["contributor", "reason"])


@query(f"""{_JUDGED_SQL} SELECT contributor, contributor_normalized, CASE contributor WHEN 'blue bolt' THEN 'accept' WHEN 'red ring' THEN 'reject' ELSE decision END AS contributor_decision,
  CASE contributor WHEN 'blue bolt' THEN 'whitelist' WHEN 'red ring' THEN 'blacklist' ELSE reason END AS contributor_reason FROM judged""")
def classify_contributors(spark, sf_dir):
    return P.classify_contributors(_named(spark, sf_dir), lists=_LISTS, whitelist=["blue bolt"], blacklist=["red ring"]).all_rows


@query(f"{_JUDGED_SQL} SELECT contributor, contributor_normalized, decision AS contributor_decision, reason AS contributor_reason, count(*) AS n_rows FROM judged WHERE decision = 'reject' GROUP BY ALL")
def rejected_contributors(spark, sf_dir):
    return P.classify_contributors(_named(spark, sf_dir), lists=_LISTS).rejected


@query(_forms_sql(lambda formatted, initial, components: f"{formatted} AS formatted"))
def name_first_last(spark, sf_dir):
    return name_forms(spark, sf_dir).withColumn("formatted", first_last_udf("name"))


@query(r"""SELECT doc_id, lower(translate(coalesce(text, ''), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', '')) AS title FROM documents""")
def title_normal_form(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.title_normal_form(F.col("text")).alias("title"))


@query("""SELECT DISTINCT l_partkey, l_partkey::VARCHAR || CASE WHEN l_partkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN l_partkey % 10 = 1 THEN 'st' WHEN l_partkey % 10 = 2 THEN 'nd' WHEN l_partkey % 10 = 3 THEN 'rd' ELSE 'th' END AS label FROM lineitem""")
def ordinal_label(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_partkey", X.ordinal(F.col("l_partkey")).alias("label")).distinct()


@query("""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing,
'[{"event_id":' || event_id || ',"k":' || coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) || '}]' AS packed FROM events""")
def json_extract_defaults(spark, sf_dir):
    read = X.json_fields(F.col("props"), {"k": ("long", 0), "missing": ("string", "none")})
    packed = X.json_records("event_id", read["k"].alias("k"))
    back = F.from_json(packed, "array<struct<event_id: long, k: long>>")
    return table(spark, sf_dir, "events").select("event_id", back[0]["k"].alias("k"), read["missing"].alias("missing"), packed.alias("packed"))


@query("""SELECT DISTINCT href, 'https://host/raw/refs/heads/data/' || list_last(string_split(href, '/')) AS file FROM (
  SELECT unnest(regexp_extract_all(html, 'href="([^"]*e)"', 1)) AS href FROM pages)""")
def html_href_extract(spark, sf_dir):
    hrefs = table(spark, sf_dir, "pages").select(F.explode(X.links_with_extension(F.col("html"), "e")).alias("href")).distinct()
    return hrefs.withColumn("file", X.raw_file_url("https://host/tree/data", F.col("href")))


@query("""SELECT i::INT AS attempt, least(10.0, pow(2, i))::DOUBLE AS delay, greatest(0, coalesce(TRY_CAST(h AS DOUBLE), 0)::INT)::INT AS header_delay
FROM (VALUES (0, '3'), (1, '-4'), (2, 'soon'), (3, '2.0'), (4, NULL), (5, '12')) t(i, h)""")
def backoff_delay(spark, sf_dir):
    """What the service's client waits, and what it makes of a header."""
    headers = ["3", "-4", "soon", "2.0", None, "12"]
    rows = [(i, service.backoff(i), service.whole_seconds(service.numeric_header({"Retry-After": h}, "retry-after")) or 0) for i, h in enumerate(headers)]
    return spark.createDataFrame(rows, "attempt int, delay double, header_delay int")


@query("""SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS balance FROM customer UNION ALL BY NAME SELECT s_suppkey AS id, s_acctbal AS balance FROM supplier""")
def union_missing_columns(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return R.union_rows(customers, suppliers)


@query("SELECT n_name, r_name IS NULL AS lacking FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA' WHERE r_name IS NULL")
def missing_institutions(spark, sf_dir):
    known = table(spark, sf_dir, "region").where("r_name <> 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"))
    return R.members(table(spark, sf_dir, "nation"), known, "n_regionkey", present=False).select("n_name", F.lit(True).alias("lacking"))


@query("SELECT count(*)::BIGINT AS n_before, count(DISTINCT c_nationkey)::BIGINT AS n_after, (count(*) - count(DISTINCT c_nationkey))::BIGINT AS n_removed FROM customer")
def rows_removed(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_nationkey")
    return R.rows_removed(customers, customers.distinct())


@query("""WITH a AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS mine FROM orders GROUP BY ALL)
SELECT o_custkey, CASE WHEN contains(array_to_string(mine, ''), 'F') OR contains(array_to_string(mine, ''), 'P') THEN array_to_string(list_filter(mine, lambda x: x IN ('F', 'P')), '|') END AS common FROM a""")
def common_elements(spark, sf_dir):
    mine = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("mine"))
    return mine.select("o_custkey", F.array_join(R.common_elements(F.col("mine"), F.array(F.lit("F"), F.lit("P"), F.lit("missing"))), "|").alias("common"))


@query(f"WITH {_PUBS} SELECT integer_id, contributor_rank::INT AS contributor_rank, contributors[contributor_rank] AS contributor FROM (SELECT *, unnest(range(1, least(len(contributors), 12) + 1)) AS contributor_rank FROM pubs)")
def column_ranks(spark, sf_dir):
    """Wide columns back to rows: the rank is the number behind the column's name."""
    wide = R.spread_list(_pubs(spark, sf_dir).select("integer_id", "contributors"), "contributors", 12).drop("contributors")
    return R.columns_to_rows(wide, ["integer_id"], "contributor_")
