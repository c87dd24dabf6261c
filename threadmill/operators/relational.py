"""Relational building blocks: filters, de-duplication, pivots, lookups, ordered selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The frame itself; a ValueError that names the columns it lacks."""
    lacking = [n for n in names if n not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def year_range(df: DataFrame, column: str, first: int, last: int) -> DataFrame:
    """Rows of the years from ``first`` to ``last``; a null year is out."""
    return df.where(F.col(column).between(first, last))


def drop_null_keys(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def equality_filter(df: DataFrame, column: str, value: object | None) -> DataFrame:
    """Rows of one value; all rows if ``value`` is None."""
    return df if value is None else require_columns(df, [column]).where(F.col(column) == value)


def distinct_rows(df: DataFrame) -> DataFrame:
    """Each row once; nulls are equal."""
    return df.distinct()


def row_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows each key has (``n_rows``); null keys are one key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"))


def rows_removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: n_before, n_after, n_removed. Two counts in one plan, none of them on the driver."""
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(0).alias("k"), F.col("n").alias(name)) for df, name in ((before, "n_before"), (after, "n_after"))]
    return counted[0].join(counted[1], "k").select("n_before", "n_after", (F.col("n_before") - F.col("n_after")).alias("n_removed"))


def union_rows(df: DataFrame, other: DataFrame) -> DataFrame:
    """All rows of both, by column name; a column that one of them lacks is null there."""
    return df.unionByName(other, allowMissingColumns=True)


def common_elements(a: Column, b: Column) -> Column:
    """The sorted common elements of two arrays; null if there is none."""
    both = F.sort_array(F.array_intersect(a, b))
    return F.when(F.size(both) > 0, both)


def suffix_number(name: str) -> int:
    """The integer behind the last underscore of a column's name."""
    return int(name.rsplit("_", 1)[1])


def move_after(df: DataFrame, column: str, anchor: str) -> DataFrame:
    """The same columns with ``column`` right behind ``anchor``; last if there is no such anchor."""
    names = [c for c in df.columns if c != column]
    at = names.index(anchor) + 1 if anchor in names else len(names)
    return df.select(*names[:at], column, *names[at:])


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_{k}"]) for k in keys])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, which has to be total; null keys are one key.

    An aggregate, so a hot key is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def keep_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once; null keys are equal."""
    often = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).count().where("count > 1").drop("count")
    return df.join(often, _same(df, often, keys), "left_semi")


def group_to_list(df: DataFrame, keys: list[str], value: str, order: list[str], name: str = "contributors") -> DataFrame:
    """One row per key with the values as an array in row order; null keys are one key."""
    pairs = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_value"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda x: x["_value"]).alias(name))


def spread_list(df: DataFrame, array: str, width: int, prefix: str = "contributor") -> DataFrame:
    """Fixed columns ``prefix``_1 ... for the first ``width`` elements."""
    return df.select("*", *[F.get(F.col(array), F.lit(i)).alias(f"{prefix}_{i + 1}") for i in range(width)])


def gather_columns(df: DataFrame, prefix: str = "contributor_") -> Column:
    """The non-null values of all columns that have ``prefix`` in their names, as an array."""
    return F.filter(F.array(*[F.col(c) for c in df.columns if prefix in c]), lambda x: x.isNotNull())


def list_to_rows(df: DataFrame, array: str, value: str = "contributor", rank: str = "contributor_rank") -> DataFrame:
    """One row per element with its rank from 1."""
    keys = [c for c in df.columns if c != array]
    return df.select(*keys, F.posexplode(array).alias("_at", value)).select(*keys, (F.col("_at") + 1).cast("int").alias(rank), value)


def columns_to_rows(df: DataFrame, keys: list[str], prefix: str, value: str = "contributor", rank: str = "contributor_rank") -> DataFrame:
    """One row per non-null column of ``prefix``, with the number behind its name as rank."""
    named = sorted((suffix_number(c), c) for c in df.columns if c.startswith(prefix))
    cells = F.array(*[F.struct(F.lit(n).alias(rank), F.col(c).alias(value)) for n, c in named])
    return df.select(*keys, F.explode(F.filter(cells, lambda x: x[value].isNotNull())).alias("_cell")).select(*keys, f"_cell.{rank}", f"_cell.{value}")


def first_n(array: Column, n: int) -> Column:
    """The first ``n`` non-null elements: gaps close up."""
    return F.slice(F.filter(array, lambda x: x.isNotNull()), 1, n)


def merge_near_duplicates(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows that agree in all other columns but ``order`` become one, with the distinct non-null values in row order."""
    others = [c for c in df.columns if c != column and c not in order]
    pairs = F.sort_array(F.collect_list(F.struct(*order, F.col(column).alias("_value"))))
    values = F.array_distinct(F.filter(F.transform(pairs, lambda x: x["_value"]), lambda v: v.isNotNull()))
    return df.groupBy(*others).agg(values.alias(column))


#: A lookup dimension of at most so many rows is broadcast.
MAX_BROADCAST_ROWS = 100_000


def dimension(spark, rows: dict[str, str], key: str, value: str) -> DataFrame:
    return spark.createDataFrame(list(rows.items()) or [(None, None)], f"{key} string, {value} string").where(F.col(key).isNotNull())


def lookup_or_self(df: DataFrame, column: str, rows: dict[str, str]) -> DataFrame:
    """Replace what the map has; all other values, null too, pass through."""
    dim = dimension(df.sparkSession, rows, "_key", "_value")
    dim = F.broadcast(dim) if len(rows) <= MAX_BROADCAST_ROWS else dim
    joined = df.join(dim, F.col(column) == F.col("_key"), "left")
    return joined.withColumn(column, F.coalesce("_value", column)).select(*df.columns)


def members(df: DataFrame, other: DataFrame, key: str, present: bool = True) -> DataFrame:
    """Rows whose key is (or isn't) among the keys of ``other``."""
    return df.join(other.select(key).where(F.col(key).isNotNull()), key, "left_semi" if present else "left_anti").select(*df.columns)


def align_to(sample: DataFrame, table: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of ``table`` in the order of ``sample``; keys that it lacks give rows of nulls.

    For samples: the result is sorted as a whole. A key that ``table`` has more than once has no one row
    to give, and fails the job with an error that names it.
    """
    rest = [c for c in table.columns if c != key]
    wanted = table.join(sample.select(key).distinct(), key, "left_semi")
    twice = F.raise_error(F.concat(F.lit(f"{key} occurs more than once: "), F.col(key).cast("string")))
    rows = wanted.groupBy(key).agg(F.first(F.struct(*rest)).alias("_row"), F.count("*").alias("_n"))
    rows = rows.select(key, F.when(F.col("_n") > 1, twice.cast(rows.schema["_row"].dataType)).otherwise(F.col("_row")).alias("_row"))
    return sample.select(key, position).join(rows, key, "left").select(position, key, *[F.col("_row")[c].alias(c) for c in rest]).orderBy(position)


def row_numbers(df: DataFrame, key: str, name: str = "row_number", buckets: int | None = None) -> DataFrame:
    """Dense numbers from 0 in the order of a unique numeric key, without one task that sorts all rows.

    The key's range is cut at its quantiles; each bucket is numbered on its own and starts where the
    ones before it end.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.stat.approxQuantile(key, [i / n for i in range(1, n)], 0.001))) if n > 1 else []
    bucket = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(key))) if cuts else F.lit(0)
    placed = df.withColumn("_bucket", bucket.cast("int"))
    counts = placed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    starts = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1
    numbered = placed.join(F.broadcast(starts), "_bucket").withColumn(name, (F.col("_start") + inside).cast("long"))
    return numbered.drop("_bucket", "_start")


def chunk(df: DataFrame, key: str, size: int, index: int) -> DataFrame:
    """The rows of chunk ``index`` in the order of ``key``, which is unique; beyond the end the last chunk, of an empty table none.

    Two sorts of keys alone, each cut at once to what the chunk needs: the first (index + 1) * size keys
    say where it ends, and its own keys pick the rows.
    """
    last = max((df.count() - 1) // size, 0)
    at = min(index, last)
    head = df.select(key).orderBy(key).limit((at + 1) * size)
    own = head.orderBy(F.desc(key)).limit(size if at < last else df.count() - at * size)
    return df.join(own, key, "left_semi")


def null_out_beyond(df: DataFrame, array: str, cutoff: int) -> DataFrame:
    """Keep the elements up to the rank ``cutoff``."""
    return df.withColumn(array, F.slice(F.col(array), 1, cutoff))


def histogram(df: DataFrame, column: str, labels: tuple[str, ...]) -> DataFrame:
    """Count of each label in its order, 0 where it doesn't occur; other values are left out."""
    domain = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(labels)], f"position int, {column} string")
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return domain.join(counts, column, "left").select("position", column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
