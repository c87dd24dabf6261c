"""Reading and writing: CSV with its null tokens, list files, YAML settings, spreadsheets, snapshots."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import chunk, drop_null_keys, equality_filter, require_columns
from ..operators.sampling import sample_rows

#: What pandas reads as missing by default. Fixed values.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, limit: int | None = None) -> DataFrame:
    """A CSV with header, quotes and line breaks inside quotes; null tokens become null, types are the schema's.

    The schema's columns are taken by name, in any order; a value that is no number is null.
    """
    want = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    require_columns(raw, [f.name for f in want])
    typed = raw.select(*[F.when(~F.col(f.name).isin(*NULL_TOKENS), F.col(f.name)).try_cast(f.dataType).alias(f.name) for f in want])
    return typed if limit is None else typed.limit(limit)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """With header; arrays and structs as JSON text."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_ordered_csv(df: DataFrame, path: str, position: str) -> None:
    """A small result in the order of ``position``, as one file."""
    df.orderBy(position).drop(position).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_nested_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """What ``write_csv`` wrote, with nested columns parsed back."""
    want = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    nested = (T.ArrayType, T.StructType, T.MapType)
    flat = read_csv(spark, path, T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, nested) else f.dataType) for f in want]))
    return flat.select(*[F.from_json(f.name, f.dataType).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in want])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: stripped lines without blank ones and comments."""
    return spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("value")).where("value <> '' AND NOT startswith(value, '#')")


def read_ids(spark: SparkSession, path: str, name: str = "integer_id") -> DataFrame:
    return read_lines(spark, path).select(F.col("value").cast("long").alias(name))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A result that an earlier run wrote; FileNotFoundError if there is none."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def read_through(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; it is built and written first if it isn't there."""
    try:
        return read_snapshot(spark, path)
    except FileNotFoundError:
        build().write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def spreadsheet_rows(data: bytes) -> list[list[str | None]]:
    """The cells of an XLSX file's first sheet as texts, row by row; empty cells are None."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = book.namelist()
        text_of = lambda e: "".join(t.text or "" for t in e.iter(f"{_SHEET}t"))
        shared = [text_of(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")] if "xl/sharedStrings.xml" in names else []
        sheet = ElementTree.fromstring(book.read(min(n for n in names if n.startswith("xl/worksheets/sheet"))))
    rows = []
    for row in sheet.iter(f"{_SHEET}row"):
        cells: dict[int, str | None] = {}
        for cell in row.iter(f"{_SHEET}c"):
            at = 0
            for letter in re.match("[A-Z]*", cell.get("r", ""))[0]:
                at = at * 26 + ord(letter) - 64
            value = cell.find(f"{_SHEET}v")
            read = text_of(cell) if cell.get("t") == "inlineStr" else None if value is None else shared[int(value.text)] if cell.get("t") == "s" else value.text
            cells[at or len(cells) + 1] = read
        rows.append([cells.get(i + 1) for i in range(max(cells, default=0))])
    return rows


def read_spreadsheets(spark: SparkSession, paths: str, column: str = "supervisor") -> DataFrame:
    """Distinct non-null values of a column of all XLSX files at a path or glob. Each file is read in one task, where it lies.

    A file without the column fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                head, *rows = spreadsheet_rows(data) or [[]]
                if column not in head:
                    raise ValueError(f"missing columns: {column} in {path}")
                at = head.index(column)
                yield pa.RecordBatch.from_arrays([pa.array([r[at] if at < len(r) else None for r in rows], pa.string())], names=[column])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(run, f"`{column}` string").where(F.col(column).isNotNull()).distinct()


def harvest_spreadsheets(spark: SparkSession, listing: str, fetch: Callable[[str], bytes], folder: str, column: str = "supervisor", extension: str = ".xlsx") -> DataFrame:
    """Fetch every file that a listing page names, once, into ``folder``, and read a column of all of them.

    ``fetch`` gives the bytes of a URL. ``folder`` is one that all executors see; files in it stay as they are.
    """
    page = fetch(listing).decode()
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    for href in listed_files(page, extension):
        file = spark._jvm.org.apache.hadoop.fs.Path(target, href.rsplit("/", 1)[-1])
        if not system.exists(file):
            out = system.create(file)
            out.write(bytearray(fetch(f"{listing.rstrip('/').replace('/tree/', '/raw/refs/heads/')}/{href.rsplit('/', 1)[-1]}")))
            out.close()
    return read_spreadsheets(spark, f"{folder}/*{extension}", column)


def write_classified(classified, folder: str) -> None:
    """What was rejected and what is to be reviewed, as one CSV each."""
    for name in ("rejected", "review"):
        write_csv(getattr(classified, name), f"{folder}/{name}")


def write_relations(relations: DataFrame, deduplicated: DataFrame, folder: str) -> None:
    """The result before and after de-duplication, and the rows that failed, as one CSV each."""
    write_csv(relations, f"{folder}/relations")
    write_csv(deduplicated, f"{folder}/relations_deduplicated")
    write_csv(relations.where("processing_error IS NOT NULL"), f"{folder}/exceptions")


def listed_files(page: str, extension: str) -> list[str]:
    """Distinct href targets of a listing page that end in the extension."""
    return list(dict.fromkeys(re.findall(rf'href="([^"]*{re.escape(extension)})"', page)))


@dataclass(frozen=True)
class DatasetConfig:
    """Which table to read and which part of it."""

    dataset_path: str
    output_filename: str
    dataset_path_sample_gold_standard: str | None = None
    output_filename_gold_standard: str | None = None
    use_sample_for_gold_standard: bool = False
    domain: str | None = None
    chunk: int | None = None
    nrows: int | None = None
    min_rank_contrib: int | None = None

    @property
    def input_path(self) -> str:
        return self.dataset_path_sample_gold_standard if self.use_sample_for_gold_standard and self.dataset_path_sample_gold_standard else self.dataset_path

    @property
    def output_path(self) -> str:
        return self.output_filename_gold_standard if self.use_sample_for_gold_standard and self.output_filename_gold_standard else self.output_filename


def read_config(path: str | None = None, variable: str = "DATASET_CONFIG") -> DatasetConfig:
    """Settings from a YAML file; an environment variable names another file."""
    import yaml

    chosen = os.environ.get(variable) or path
    if not chosen:
        raise FileNotFoundError("no configuration file is named")
    raw = yaml.safe_load(Path(chosen).read_text()) or {}
    known = DatasetConfig.__dataclass_fields__
    return DatasetConfig(**{k: v for k, v in raw.items() if k in known and v != ""})


def read_dataset(spark: SparkSession, config: DatasetConfig, schema: str | T.StructType, seed: int = 42, key: str = "integer_id", name: str = "phd_name") -> DataFrame:
    """The configured part of a dataset: by domain, then a chunk or a seeded sample of ``nrows``, without null names.

    A chunk beyond the end is the last one; a chunk without ``nrows`` is no chunk.
    """
    rows = read_csv(spark, config.input_path, schema)
    rows = equality_filter(rows, "domain", config.domain)
    if config.nrows and config.chunk is not None:
        rows = chunk(rows, key, config.nrows, config.chunk)
    elif config.nrows:
        rows = sample_rows(rows, config.nrows, seed, key).drop("position")
    return drop_null_keys(rows, name)


def read_secret(path: str) -> str | None:
    """The first line of a file, or None; never logged."""
    p = Path(path)
    return p.read_text().strip().split("\n")[0] or None if p.exists() else None
