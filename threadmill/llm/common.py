"""Helpers that the corpus operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stages import cut, remove, shared_folder  # noqa: F401

#: Bytes that part words: everything of ASCII but digits and letters.
ALNUM_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
#: Bytes that part words where only ASCII white space does.
SPACE_SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of the filters below (8 MB). A fuller filter lets more pass, it never loses a key.
FILTER_BITS = 1 << 26


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """Which residues of 64-bit keys occur, as bits in 32-bit words: a filter of fixed size for any number of keys."""
    place = F.pmod(F.col(column), F.lit(FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 32).cast("int"))
    words = keys.select(F.floor(place / 32).cast("int").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    rows = words.toArrow()  # FILTER_BITS / 32 rows at most
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that are surely not in the filter."""
    at = keys.astype(np.int64) % FILTER_BITS
    return (bits[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1


def translation(separators: bytes) -> bytes:
    """Table for ``bytes.translate``: A-Z to a-z, separators to a blank, all else as it is."""
    out = bytearray(range(256))
    for b in range(65, 91):
        out[b] = b + 32
    for b in separators:
        out[b] = 32
    return bytes(out)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets, without a copy; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def clean_text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def row_chunks(offsets: np.ndarray, limit: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each; a longer row has a range of its own."""
    out, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        out.append((lo, hi))
        lo = hi
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    known = _POWERS.get(str(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 20), base, np.uint64)
        known[0] = 1
        _POWERS[str(base)] = known = np.multiply.accumulate(known)
    return known[:n]


class Words:
    """The words of some texts: byte places, the text of each, and a 64-bit hash of each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, is_separator: np.ndarray, values: np.ndarray):
        n = len(raw)
        self.offsets = offsets
        if n == 0:
            self.start = self.end = self.text = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        inside = ~is_separator[raw]
        first = np.zeros(n + 1, bool)
        first[offsets] = True  # a word never goes on into the next text
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[raw] * _powers(_BASE, n), out=sums[1:])
        own = (sums[self.end] - sums[self.start]) * _powers(_INVERSE, n)[self.start]
        self.hash = mix64(own + (self.end - self.start).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=len(self.offsets) - 1)


def byte_values(lower: bool) -> np.ndarray:
    """A fixed random number for each byte; capitals have those of small letters if ``lower``."""
    values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if lower:
        values[65:91] = values[97:123]
    return values


def separator_mask(separators: bytes) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(separators)] = True
    return mask
