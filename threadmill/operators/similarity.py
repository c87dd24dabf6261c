"""Title similarity by hashed character n-grams, the default encoder, and vectors that are compared by place."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.ml.feature import HashingTF, NGram, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import title_normal_form
from ..functions.vectors import dot

#: References are compared so many at a time, and so many pairs are worked out at once.
REFERENCES_AT_ONCE, PAIRS_AT_ONCE = 4096, 500_000


def _with_vectors(titles: DataFrame, n: int, size: int) -> DataFrame:
    """Add the unit vector (``vector``) of the normalised titles ``normal``."""
    letters = titles.withColumn("_letters", F.split(F.concat(F.lit(" "), F.col("normal"), F.lit(" ")), ""))
    grams = NGram(n=n, inputCol="_letters", outputCol="_grams").transform(letters)
    hashed = HashingTF(numFeatures=size, inputCol="_grams", outputCol="_tf").transform(grams)
    unit = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(hashed)
    return unit.withColumn("vector", vector_to_array("_unit")).drop("_letters", "_grams", "_tf", "_unit")


def encode_titles(titles: DataFrame, column: str, n: int = 3, size: int = 1024) -> DataFrame:
    """Distinct normalised titles (``normal``) with unit vectors (``vector``); blank titles have none.

    Encoding runs once for each distinct title, however often it occurs.
    """
    distinct = titles.select(title_normal_form(F.col(column)).alias("normal")).where("trim(normal) <> ''").distinct()
    return _with_vectors(distinct, n, size).select("normal", "vector")


def ngram_similarity(pairs: DataFrame, title: str, reference: str, encode: Callable[[DataFrame, str], DataFrame] = encode_titles) -> DataFrame:
    """Add ``similarity`` of two title columns; null where one of them is blank or null. ``encode`` is as ``encode_titles``."""
    both = pairs.select(F.col(title).alias("t")).unionByName(pairs.select(F.col(reference).alias("t")))
    vectors = encode(both, "t")
    keyed = pairs.withColumn("_a", title_normal_form(F.col(title))).withColumn("_b", title_normal_form(F.col(reference)))
    for key, out in (("_a", "_va"), ("_b", "_vb")):
        keyed = keyed.join(vectors.select(F.col("normal").alias(key), F.col("vector").alias(out)), key, "left")
    return keyed.withColumn("similarity", dot(F.col("_va"), F.col("_vb"))).drop("_a", "_b", "_va", "_vb")


_models: dict[str, Callable[[list[str]], np.ndarray]] = {}


def model_encoder(name: str, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[DataFrame, str], DataFrame]:
    """An encoder by a model: ``load`` gives a function from texts to rows of numbers, and runs once in each Python worker.

    Workers keep the model under ``name``. A text whose vector has no length has none. Distinct titles
    are encoded once, in Arrow batches.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if name not in _models:
            _models[name] = load()
        for texts in batches:
            rows = np.asarray(_models[name](texts.to_pylist()), np.float64).reshape(len(texts), -1)
            length = np.linalg.norm(rows, axis=1)
            yield pa.array([list(row / n) if n > 0 else None for row, n in zip(rows, length)], pa.list_(pa.float64()))

    def encode(titles: DataFrame, column: str) -> DataFrame:
        distinct = titles.select(title_normal_form(F.col(column)).alias("normal")).where("trim(normal) <> ''").distinct()
        return distinct.select("normal", F.arrow_udf(run, T.ArrayType(T.DoubleType()))(F.col("normal")).alias("vector"))

    return encode


def ngram_similarity_all(texts: DataFrame, references: DataFrame, text_id: str, text: str, reference_id: str, reference: str, n: int = 3, size: int = 1024) -> DataFrame:
    """(text_id, reference_id, similarity) of every text with every reference; null where one of them is blank or null.

    Texts are encoded where they are read, and no text is shuffled. The references' vectors go to the
    executors in blocks of ``REFERENCES_AT_ONCE`` at most.
    """

    def encoded(df: DataFrame, key: str, column: str) -> DataFrame:
        normal = df.select(F.col(key), title_normal_form(F.col(column)).alias("normal"))
        return _with_vectors(normal, n, size).select(key, F.when(F.trim("normal") != "", F.col("vector")).alias("vector"))

    id_type, reference_type = texts.schema[text_id].dataType.simpleString(), references.schema[reference_id].dataType.simpleString()
    own = encoded(texts, text_id, text)
    n_blocks = max(1, math.ceil(references.count() / REFERENCES_AT_ONCE))
    found = None
    for b in range(n_blocks):
        block = encoded(references.where(F.pmod(F.xxhash64(reference_id, reference), F.lit(n_blocks)) == b), reference_id, reference).toArrow()
        part = own.mapInArrow(_against(texts, block, text_id, reference_id, size), f"{text_id} {id_type}, {reference_id} {reference_type}, similarity double")
        found = part if found is None else found.unionByName(part)
    return found


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """The vectors as rows; a null is a row of NaN."""
    out = np.full((len(vectors), size), np.nan)
    there = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    out[there] = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    return out


def _against(texts: DataFrame, block: pa.Table, text_id: str, reference_id: str, size: int):
    """What compares batches of encoded texts with a block of encoded references."""
    ids = block.column(reference_id).combine_chunks()
    sent = texts.sparkSession.sparkContext.broadcast((ids, _matrix(block.column("vector").combine_chunks(), size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = sent.value
        step = max(1, PAIRS_AT_ONCE // max(1, len(ids)))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                m = part.num_rows
                similarity = (_matrix(part.column("vector"), size) @ matrix.T).ravel()
                left = part.column(text_id).take(pa.array(np.repeat(np.arange(m), len(ids))))
                right = ids.take(pa.array(np.tile(np.arange(len(ids)), m)))
                yield pa.RecordBatch.from_arrays([left, right, pa.array(similarity, mask=np.isnan(similarity))], names=[text_id, reference_id, "similarity"])

    return run


#: A worker has so many pairs of vectors in memory at once.
_COSINES_AT_ONCE = 20_000


class VectorTable:
    """Vectors by place, to compare any two of them. A vector without numbers can't be compared, nor two of different lengths."""

    def __init__(self, places: np.ndarray, embeddings: pa.ChunkedArray, n: int):
        self.present, self.size, self.length = np.zeros(n, bool), np.zeros(n, np.int32), np.zeros(n)
        longest = max((int(pc.max(pc.list_value_length(c)).as_py() or 0) for c in embeddings.chunks), default=0)
        self.vectors = np.zeros((n, longest), embeddings.type.value_type.to_pandas_dtype())
        at = 0
        for chunk in embeddings.chunks:
            values, ends = chunk.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(pc.list_value_length(chunk).to_numpy()))
            for place, lo, hi in zip(places[at : at + len(chunk)], ends, ends[1:]):
                self.vectors[place, : hi - lo], self.size[place], self.present[place] = values[lo:hi], hi - lo, True
            at += len(chunk)
        for lo in range(0, n, _COSINES_AT_ONCE):
            x = self.vectors[lo : lo + _COSINES_AT_ONCE].astype(float)
            self.length[lo : lo + _COSINES_AT_ONCE] = np.sqrt(np.einsum("ij,ij->i", x, x))

    def similar(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of the vectors at the places ``a`` and ``b``, and which of them are known."""
        out = np.empty(len(a))
        for lo in range(0, len(a), _COSINES_AT_ONCE):
            one, other = (self.vectors[x[lo : lo + _COSINES_AT_ONCE]].astype(float) for x in (a, b))
            out[lo : lo + _COSINES_AT_ONCE] = np.einsum("ij,ij->i", one, other)
        with np.errstate(all="ignore"):
            out /= self.length[a] * self.length[b]
        return out, (self.size[a] == self.size[b]) & (self.length[a] != 0) & (self.length[b] != 0)


def similar_to_each(sent: Broadcast) -> Callable[..., Column]:
    """A function of a place and an array of places of the ``VectorTable`` sent: the array of their cosines; null if nothing is at the place."""

    @F.arrow_udf("array<double>")
    def similar(place: pa.Array, places: pa.Array) -> pa.Array:
        table = sent.value
        n = len(table.present)
        count = pc.fill_null(pc.list_value_length(places), 0).to_numpy(zero_copy_only=False)
        a, b = pc.fill_null(place, -1).to_numpy(zero_copy_only=False), pc.fill_null(places.flatten(), -1).to_numpy(zero_copy_only=False)
        (a, there), (b, inside) = ((np.clip(x, 0, n - 1), (x >= 0) & (x < n)) for x in (a, b))
        there &= table.present[a]
        out, known = table.similar(np.repeat(a, count), b)
        ends = np.append(0, np.cumsum(count)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out, mask=~(known & inside)), mask=pa.array(~there))

    return similar
