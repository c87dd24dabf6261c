"""Benchmark decontamination by Wu-Manber search over words.

An item's windows are its runs of 13 consecutive words (a shorter item is one window). Windows of
equal length share a matcher: a shift table by blocks of three words says how far the search may
jump, a suffix-hash bucket holds the windows that end in a block of shift 0, and a direct comparison
of all words confirms an occurrence. A benchmark of any size is searched so: its items are dealt into
pattern shards of bounded memory, one pass over the documents each.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_SEPARATORS, cut, table, translation

WINDOW = 13
BLOCK = 3
#: A document is contaminated if one of so many of its words is hit.
ONE_IN = 20
#: A pattern shard has about so many bytes of benchmark; its tables take up to 125 times as much memory in a worker (measured).
SHARD_BYTES = 2 << 20
#: Longer items are cut into pieces of so many words, which overlap so that every window is in one of them.
PIECE_WORDS = 20_000
_TO_WORDS = translation(ALNUM_SEPARATORS)


def words_of(text: str | bytes | None) -> list[bytes]:
    """The words of a text as UTF-8; none for null."""
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(_TO_WORDS).split()


class WuManber:
    """Finds all occurrences of word sequences of one length. Words are numbers of one vocabulary."""

    def __init__(self, length: int, size: int):
        self.length, self.block, self.size = length, min(BLOCK, length), size
        self.far = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, dict[tuple[int, ...], set]] = defaultdict(dict)

    def key(self, words: list[int], end: int) -> int:
        """The block of words before ``end`` as one number."""
        key = 0
        for word in words[end - self.block : end]:
            key = key * self.size + word
        return key

    def add(self, window: list[int], item: str | None) -> None:
        shift, far, length = self.shift, self.far, self.length
        for end in range(self.block, length + 1):
            key = self.key(window, end)
            if length - end < shift.get(key, far):
                shift[key] = length - end
        self.bucket[self.key(window, length)].setdefault(tuple(window), set()).add(item)

    def search(self, words: list[int]) -> Iterator[tuple[int, set]]:
        """Start and items of each occurrence. A word that no window has is -1."""
        shift, far, size, length, block = self.shift, self.far, self.size, self.length, self.block
        at, end = length, len(words)
        while at <= end:
            key = 0
            for word in words[at - block : at]:
                if word < 0:
                    key = -1
                    break
                key = key * size + word
            jump = shift.get(key, far)
            if jump:
                at += jump
                continue
            # the words themselves are compared, however many windows end in this block
            items = self.bucket[key].get(tuple(words[at - length : at]))
            if items is not None:
                yield at - length, items
            at += 1


class Patterns:
    """The matchers of some items, one for each length of their windows; items without words have none."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        split = [(item, words_of(text)) for item, text in items]
        self.vocabulary: dict[bytes, int] = {}
        for _, words in split:
            for word in words:
                self.vocabulary.setdefault(word, len(self.vocabulary))
        by_length: dict[int, WuManber] = {}
        for item, words in split:
            numbers = [self.vocabulary[w] for w in words]
            n = min(window, len(words))
            if n:
                matcher = by_length.setdefault(n, WuManber(n, len(self.vocabulary)))
                for at in range(len(words) - n + 1):
                    matcher.add(numbers[at : at + n], item)
        self.matchers = [by_length[n] for n in sorted(by_length)]

    def find(self, text: str | bytes | None) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, hit spans and items of a text."""
        words = words_of(text)
        known = self.vocabulary.get
        numbers = [known(w, -1) for w in words]
        found = [(start, start + m.length, who) for m in self.matchers for start, who in m.search(numbers)]
        return len(words), _spans([x[:2] for x in found]), set().union(*(x[2] for x in found))


_built: dict[str, Patterns] = {}


def _patterns(key: str, items: list[tuple[str | None, str | None]], window: int) -> Patterns:
    """The patterns of a worker: built once, and kept until others are asked for."""
    if key not in _built:
        _built.clear()
        _built[key] = Patterns(items, window)
    return _built[key]


def _spans(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans become one."""
    out: list[list[int]] = []
    for start, end in sorted(found):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", _SPAN), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("unnamed", T.BooleanType())])
_FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())), ("unnamed", pa.bool_())])


def _searched(spark: SparkSession, items: list[tuple[str | None, str | None]], window: int) -> Column:
    """What the search of ``text`` for some items finds, as a struct. Texts alone go to Python."""
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, items))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        patterns = _patterns(*sent.value, window)
        for texts in batches:
            out = []
            for text in texts:
                n, spans, who = patterns.find(text.as_py())
                out.append({"n_words": n, "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted(x for x in who if x is not None), "unnamed": None in who})
            yield pa.array(out, _FOUND_ARROW)

    return F.arrow_udf(run, _FOUND)(F.col("text"))


def _pieces(benchmark: DataFrame, window: int, piece_words: int) -> DataFrame:
    """(item, text) with every window of every item in exactly one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                n = len(words) - min(window, len(words)) + 1 if words else 0
                parts = [b" ".join(words[at : min(at + piece_words, n) + window - 1]).decode() for at in range(0, n, piece_words)]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array(parts, pa.string())], names=["item", "text"])

    return benchmark.mapInArrow(run, "item string, text string")


def _merged(spans: Column) -> Column:
    """Sorted spans, of which overlapping and touching ones become one."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (F.element_at(F.concat(acc, F.array(x)), -2)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), none, step)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = ONE_IN, keep: list[str] | None = None, shard_bytes: int = SHARD_BYTES, piece_words: int = PIECE_WORDS) -> DataFrame:
    """Per input row: the columns of ``keep`` and n_words, n_hit, n_items, items, spans, contaminated.

    ``benchmark`` has item_id, of any type that has a text, and text. Null and empty texts have no words
    and are never hit; items without words are ignored; items without id count as one item without a
    name. Repeated rows are searched one by one, and equal items are all named. ``items`` are in the
    order of their texts. Very long texts are searched in whole. ``keep`` may have any names but those of
    the results, which are a ValueError; other columns are ignored. Empty tables give no rows or no hits.

    The benchmark's size is measured. One of up to ``shard_bytes`` is searched in one pass without a
    shuffle. A larger one is dealt into shards of that size by a hash of its pieces: documents are
    written once with row numbers, each shard is one pass over them, and only rows with hits are shuffled.
    """
    keep = keep or ["doc_id"]
    results = ["n_words", "n_hit", "n_items", "items", "spans", "contaminated"]
    if set(keep) & set(results):
        raise ValueError(f"columns of the result cannot be kept: {', '.join(sorted(set(keep) & set(results)))}")
    spark = docs.sparkSession
    read = docs.select(F.struct(*dict.fromkeys(keep)).alias("_keep"), F.col("text"))
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + 64 * F.count("*")).first()[0]
    if size <= shard_bytes:
        found = read.select("_keep", _searched(spark, [tuple(r) for r in bench.collect()], window).alias("_found")).select("_keep", "_found.*")
    else:
        pieces = cut(_pieces(bench, window, piece_words).where("text <> ''"))
        n_shards = math.ceil(2 * size / shard_bytes)  # a hash deals unevenly
        rows = cut(read.withColumn("_row", F.monotonically_increasing_id()))
        hits = None
        for shard in range(n_shards):
            items = [tuple(r) for r in pieces.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_shards)) == shard).collect()]
            part = rows.select("_row", _searched(spark, items, window).alias("_found")).select("_row", "_found.*").where("size(spans) > 0").drop("n_words")
            hits = cut(part) if hits is None else hits.unionByName(cut(part))
        by_row = hits.groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.bool_or("unnamed").alias("unnamed"))
        counted = rows.select("_row", "_keep", _n_words(F.col("text")).alias("n_words"))
        found = counted.join(by_row.withColumn("spans", _merged(F.col("spans"))), "_row", "left").select(
            "_keep", "n_words", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("unnamed", F.lit(False)).alias("unnamed")
        )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    counted = found.select("_keep", "n_words", n_hit.alias("n_hit"), (F.size("items") + F.col("unnamed").cast("int")).cast("long").alias("n_items"), "items", "spans")
    judged = counted.withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))
    return judged.select(*[F.col("_keep")[c].alias(c) for c in dict.fromkeys(keep)], *results)


def _n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
