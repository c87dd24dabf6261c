"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded from its signs and words; gated
attention, learned from labels of whole documents, weighs the encoded passages, and the weighted sum
is scored. The weights are fitted on a bounded sample of labelled rows; every document is scored in
whole, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_SEPARATORS, Words, byte_values, mix64, row_chunks, separator_mask, table, text_buffer

PASSAGE_WORDS = 64
#: The model is fitted on at most so many labelled documents, and so many passages of each.
MAX_FIT_DOCUMENTS, MAX_FIT_PASSAGES = 4000, 64
THRESHOLD = 0.3
FOLDS, HELD_OUT_FOLD = 5, 0
_ENCODED, _GATES, _STEPS, _RATE, _DECAY = 16, 8, 400, 0.02, 1e-4

#: Kinds of bytes; each one's share of a passage is a feature.
_KINDS = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "point": b".,;:'\"()-?", "shout": b"!", "bar": b"|", "space": b" \t\r\x0b\x0c", "line": b"\n"}
_SPACE = separator_mask(SPACE_SEPARATORS)
_VALUES = byte_values(lower=False)


def _kind_table() -> np.ndarray:
    kind = np.full(256, len(_KINDS), np.uint8)  # other signs of ASCII
    for k, signs in enumerate(_KINDS.values()):
        kind[list(signs)] = k
    kind[128:] = len(_KINDS) + 1
    return kind


_KIND = _kind_table()
_N_KINDS = len(_KINDS) + 2
N_FEATURES = _N_KINDS + 9


def _encode(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and how many each text has (one at least)."""
    words = Words(raw, offsets, _SPACE, _VALUES)
    n_texts = len(offsets) - 1
    counts = words.counts()
    passages = np.maximum(1, -(-counts // PASSAGE_WORDS))
    first_passage = np.cumsum(passages) - passages
    first_word = np.cumsum(counts) - counts
    total = int(passages.sum())
    passage = first_passage[words.text] + (np.arange(len(words.text)) - first_word[words.text]) // PASSAGE_WORDS
    # a passage's bytes run from its first word to that of the next one; the first has what stands before
    begin = np.repeat(offsets[:-1], passages)
    opens = np.flatnonzero(np.diff(passage, prepend=-1)) if len(passage) else np.zeros(0, np.int64)
    later = passage[opens] != first_passage[words.text[opens]]
    begin[passage[opens][later]] = words.start[opens][later]
    sizes = np.diff(np.append(begin, len(raw)))
    of_byte = np.repeat(np.arange(total, dtype=np.int64) * _N_KINDS, sizes)
    shares = np.bincount(of_byte + _KIND[raw], minlength=total * _N_KINDS).reshape(total, _N_KINDS) / np.maximum(1, sizes)[:, None]
    n = np.bincount(passage, minlength=total)
    some = np.maximum(1, n)
    length = (words.end - words.start).astype(np.float64)
    mean = np.bincount(passage, length, total) / some
    spread = np.sqrt(np.maximum(0, np.bincount(passage, length * length, total) / some - mean * mean))
    keyed = words.hash ^ mix64(passage.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keyed)
    new = np.ones(len(keyed), bool)
    new[1:] = keyed[order][1:] != keyed[order][:-1]
    distinct = np.bincount(passage[order][new], minlength=total) / some
    first_sign, last_sign = (raw[words.start], raw[words.end - 1]) if len(raw) else (np.zeros(0, np.uint8),) * 2
    capital = np.bincount(passage, (_KIND[first_sign] == 1).astype(float), total) / some
    odd_end = np.bincount(passage, (_KIND[last_sign] == len(_KINDS)).astype(float), total) / some
    short = np.bincount(passage, (length <= 3).astype(float), total) / some
    long = np.bincount(passage, (length >= 12).astype(float), total) / some
    same = np.zeros(len(passage))
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (passage[1:] == passage[:-1])
    again = np.bincount(passage, same, total) / some
    extra = np.stack([mean / 10, spread / 10, distinct, capital, odd_end, short, long, again, np.log1p(n) / 5], 1)
    assert len(passages) == n_texts
    return np.concatenate([shares, extra], 1).astype(np.float32), passages


def encode_texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, features and passages by text, for one part of the rows after the other."""
    raw, offsets = text_buffer(column)
    for lo, hi in row_chunks(offsets):
        yield lo, *_encode(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


@dataclass
class MilModel:
    """Standardisation and weights; ``score`` is between 0 and 1."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def score(self, features: np.ndarray, passages: np.ndarray) -> np.ndarray:
        return _forward(self.w, (features - self.mean) / self.scale, passages)["p"]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, passages: np.ndarray) -> dict[str, np.ndarray]:
    begin = np.cumsum(passages) - passages
    h = np.tanh(x @ w["W"] + w["b"])
    gate, open_ = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (gate * open_) @ w["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), passages))
    attention = e / np.repeat(np.add.reduceat(e, begin), passages)
    z = np.add.reduceat(attention[:, None] * h, begin, axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
    return {"h": h, "gate": gate, "open": open_, "attention": attention, "z": z, "p": p}


def fit_model(features: np.ndarray, passages: np.ndarray, labels: np.ndarray) -> MilModel:
    """Fit by Adam on all bags at once; always the same for the same rows in the same order."""
    random = np.random.default_rng(7)
    mean, scale = features.mean(0), features.std(0) + 1e-3
    x = ((features - mean) / scale).astype(np.float64)
    d = x.shape[1]
    w = {
        "W": random.normal(0, d**-0.5, (d, _ENCODED)), "b": np.zeros(_ENCODED), "V": random.normal(0, 0.3, (_ENCODED, _GATES)), "U": random.normal(0, 0.3, (_ENCODED, _GATES)),
        "a": random.normal(0, 0.3, _GATES), "c": random.normal(0, 0.3, _ENCODED), "d": np.zeros(1),
    }
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, _STEPS + 1):
        f = _forward(w, x, passages)
        err = (f["p"] - labels) / len(labels)
        g = {"c": f["z"].T @ err, "d": err.sum(keepdims=True)}
        dz = np.repeat(err[:, None] * w["c"], passages, axis=0)
        dh = f["attention"][:, None] * dz
        da = (dz * f["h"]).sum(1)
        pooled = np.add.reduceat(f["attention"] * da, np.cumsum(passages) - passages)
        de = f["attention"] * (da - np.repeat(pooled, passages))
        g["a"] = (f["gate"] * f["open"]).T @ de
        both = de[:, None] * w["a"]
        dgate, dopen = both * f["open"] * (1 - f["gate"] ** 2), both * f["gate"] * f["open"] * (1 - f["open"])
        g["V"], g["U"] = f["h"].T @ dgate, f["h"].T @ dopen
        dh = (dh + dgate @ w["V"].T + dopen @ w["U"].T) * (1 - f["h"] ** 2)
        g["W"], g["b"] = x.T @ dh, dh.sum(0)
        for k in w:
            g[k] = g[k] + _DECAY * w[k]
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
            w[k] = w[k] - _RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return MilModel(mean, scale, w)


def is_held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def fit_on_labels(docs: DataFrame, labels: DataFrame, max_documents: int = MAX_FIT_DOCUMENTS) -> MilModel | None:
    """Fit on at most ``max_documents`` labelled documents that aren't held out; None without any.

    The sample is the rows of the smallest id hashes, so it is the same wherever it is drawn. Rows
    without id or label are left out; of several labels of an id the smallest counts.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~is_held_out())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
    )
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    schema = "doc_id long, quality int, passages int, features binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, quality = batch.column("doc_id").to_pylist(), batch.column("quality").to_pylist()
            for lo, features, passages in encode_texts(batch.column("text")):
                ends = np.cumsum(passages)
                rows = []
                for k, (a, b) in enumerate(zip(ends - passages, ends)):
                    even = np.unique(np.linspace(a, b - 1, min(b - a, MAX_FIT_PASSAGES)).astype(np.int64))
                    rows.append((ids[lo + k], quality[lo + k], len(even), features[even].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["doc_id", "quality", "passages", "features"])

    rows = sorted(tuple(r) for r in picked.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("quality", F.col("quality").cast("int")).mapInArrow(run, schema).collect())
    if not rows:
        return None
    features = np.concatenate([np.frombuffer(r[3], np.float32).reshape(-1, N_FEATURES) for r in rows])
    return fit_model(features, np.array([r[2] for r in rows]), np.array([float(r[1] > 0) for r in rows]))


def score_documents(docs: DataFrame, model: MilModel | None, keep: list[str] | None = None) -> DataFrame:
    """Per input row: the columns of ``keep`` and ``score``.

    A null or empty text is a bag of one empty passage. Without a model every score is one half.
    Repeated rows are scored alike.
    """
    if model is None:
        return docs.select(*(keep or ["doc_id"]), F.lit(0.5).alias("score"))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            scores = np.empty(len(texts))
            for lo, features, passages in encode_texts(texts):
                scores[lo : lo + len(passages)] = model.score(features, passages)
            yield pa.array(scores)

    # texts alone go to Python; what is carried along stays in the JVM
    return docs.select(*(keep or ["doc_id"]), F.arrow_udf(run, T.DoubleType())(F.col("text")).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep`` and held_out, score, predicted, for every row of ``docs``."""
    keep = keep or ["doc_id"]
    scored = score_documents(docs, fit_on_labels(docs, labels), list(dict.fromkeys([*keep, "doc_id"])))
    return scored.select(*keep, is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
