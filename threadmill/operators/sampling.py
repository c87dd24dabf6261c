"""Reproducible samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..stages import cut
from .relational import MAX_BROADCAST_ROWS, row_numbers


#: A sample that pandas would take needs a permutation of all row numbers, which is made on the driver.
MAX_NUMPY_ROWS = 20_000_000


def hash_order(id_col: str, seed: int) -> Column:
    """An order by a hash that any engine has: of the id's text, a colon and the seed."""
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))).cast("binary"))


def top_by_order(df: DataFrame, order: Column, id_col: str, n: int) -> DataFrame:
    """The first ``n`` rows of an order, with their position from 0."""
    top = df.withColumn("_order", order).orderBy("_order", id_col).limit(n)
    at = F.row_number().over(Window.orderBy("_order", id_col)) - 1  # n rows
    return top.withColumn("position", at.cast("long")).drop("_order")


def sample_rows(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """A seeded simple random sample of min(n, all) rows, the same however the table is partitioned."""
    return top_by_order(df, hash_order(id_col, seed), id_col, n)


def numpy_positions(n_rows: int, n: int, seed: int) -> list[int]:
    """Row positions that a seeded pandas sample without replacement takes, in its order."""
    return np.random.RandomState(seed).choice(n_rows, size=min(n, n_rows), replace=False).tolist()


def numpy_sample(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """The rows that pandas would sample from the table in the order of ``id_col``, with their position.

    For tables of up to ``MAX_NUMPY_ROWS`` rows, a ValueError beyond: ``sample_rows`` has no such bound.
    """
    n_rows = df.count()
    if n_rows > MAX_NUMPY_ROWS:
        raise ValueError(f"{n_rows} rows are too many for a sample as pandas takes it")
    positions = numpy_positions(n_rows, n, seed)
    wanted = df.sparkSession.createDataFrame([(p, i) for i, p in enumerate(positions)] or [(-1, -1)], "_at long, position long")
    wanted = F.broadcast(wanted) if len(positions) <= MAX_BROADCAST_ROWS else wanted
    return row_numbers(df, id_col, "_at").join(wanted, "_at").drop("_at")


def sample_with_replacement_rows(df: DataFrame, unwanted: DataFrame, n: int, order: Column, replacement_order: Column, id_col: str) -> DataFrame:
    """A sample in which rows with unwanted ids are replaced, in place, by rows of a second sample.

    Replacements have neither an unwanted id nor one of the base sample. Raises ValueError if there
    are too few of them, if an unwanted id is left, or if an id occurs twice.
    """
    base = cut(top_by_order(df, order, id_col, n))
    bad = unwanted.select(id_col).distinct()
    marked = base.join(bad.withColumn("_bad", F.lit(True)), id_col, "left")
    holes = marked.where("_bad").select("position")
    n_holes = holes.count()
    if not n_holes:
        return base
    pool = df.join(bad, id_col, "left_anti").join(base.select(id_col), id_col, "left_anti").select(*df.columns)
    fill = top_by_order(pool, replacement_order, id_col, n_holes).withColumnRenamed("position", "_k")
    if fill.count() < n_holes:
        raise ValueError(f"{n_holes} rows have to be replaced, but the pool has only {fill.count()}")
    numbered = holes.withColumn("_k", (F.row_number().over(Window.orderBy("position")) - 1).cast("long"))  # n rows at most
    filled = fill.join(numbered, "_k").select(*df.columns, "position")
    out = marked.where("_bad IS NULL").select(*df.columns, "position").unionByName(filled)
    check = out.agg(F.count(id_col).alias("n"), F.countDistinct(id_col).alias("distinct")).first()
    if check["n"] != check["distinct"]:
        raise ValueError("the sample has an id twice")
    return out
