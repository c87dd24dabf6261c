"""The corpus pipeline: quality, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.llm import bpe, decontaminate, jaccard, quality
from threadmill.llm.common import clean_text, key_filter, passes, table
from threadmill.stages import cut, remove, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies: word n-grams of this length, and the least Jaccard similarity in hundredths.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Clean ones stay, whatever their order or copies."""
    judged = quality.classify(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return judged.where("predicted = 1").select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the least id.

    Rows of the same id and text are one document. A row without id stays only where no document with
    an id is a near copy of it. Texts without words are no copies of each other.
    """
    found = cut(jaccard.jaccard_components(docs, n=NEAR_WORDS, percent=NEAR_PERCENT, text_key=True).drop("n_shingles"))
    other = F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    rows = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("copies"), F.bool_or(other).alias("gone")).where("gone OR copies > 1")
    rows = rows.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "gone")
    sent = spark.sparkContext.broadcast(key_filter(rows, "_key"))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for keys in batches:
            yield pa.array(passes(sent.value, keys.to_numpy(zero_copy_only=False)))

    # a filter of fixed size lets most rows through; those that may be gone or repeated are joined exactly
    keyed = docs.select(*COLUMNS, F.xxhash64(clean_text(F.col("text"))).alias("text_key"))
    marked = keyed.withColumn("_maybe", F.arrow_udf(run, T.BooleanType())(F.col("text_key")))
    maybe = marked.where("_maybe")
    judged = maybe.join(rows, maybe["doc_id"].eqNullSafe(F.col("_id")) & (maybe["text_key"] == F.col("_key")), "left")
    alone = judged.where("gone IS NULL").select(*COLUMNS)
    repeated = judged.where("NOT gone").dropDuplicates(["doc_id", "text_key"]).select(*COLUMNS)
    return marked.where("NOT _maybe").select(*COLUMNS).unionByName(alone).unionByName(repeated)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stands in windows of benchmark items."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document that is left, with the digest of the text that they decode to."""
    return bpe.round_trip(docs, bpe.tokenizer_file())


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", keep_uncontaminated),
    ("BPE encoding and decoding", to_tokens),
]

#: A learned classifier and a tokenizer's merges have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    A stage's folder goes when the next one is written; the last one stays, as the result reads it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        at = f"{folder}/{name.replace(' ', '_')}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            remove(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
