"""The driver tables and the relations they stand in for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Row order of a thesis's contributors: unique in ``lineitem``.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(thesis, contributor) rows: integer_id, year, contributor and the row order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("contributor"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("o_orderkey").alias("integer_id"), "year", "contributor", *LINE_ORDER)


def text_lines(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """(key, name): every line of every whole text, white space tidied, without empty ones."""
    line = F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")
    return table(spark, sf_dir, name).select(key, line).select(key, F.trim(F.regexp_replace("line", r"[ \t\n\x0B\f\r]+", " ")).alias("name")).where("name <> ''")


#: Spellings of a two-word name as ``f l``, what standardising makes of them, and initial and surname components as SQL over f and l.
NAME_FORMS = (
    ("f || ' ' || l", "f || ' ' || l", "f", "l"),
    ("l || ', ' || f", "f || ' ' || l", "f", "l"),
    ("'Prof. dr. ' || f || ' ' || l", "f || ' ' || l", "f", "l"),
    ("l || ', ' || f || ' M., PhD'", "f || ' M. ' || l", "f", "l"),
    ("'van der ' || l || ', ' || f", "f || ' van der ' || l", "f", "l"),
    ("l || ', ' || f || ' de'", "f || ' de ' || l", "f", "l"),
    ("f || ' ' || l || '-' || f", "f || ' ' || l || '-' || f", "f", "l || '|' || f"),
    ("f || ' (' || l || ') ' || l", "f || ' ' || l", "f", "l"),
    ("'É. ' || l", "'É. ' || l", "'E'", "l"),
)


def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names, in all spellings."""
    words = F.split("p_name", " ")
    names = table(spark, sf_dir, "part").select("p_name").distinct().select(words[0].alias("f"), words[1].alias("l")).where("l IS NOT NULL")
    return names.select(F.explode(F.array(*[F.expr(form) for form, *_ in NAME_FORMS])).alias("name")).distinct()
