"""Byte-level BPE encoding and decoding with a given vocabulary.

Texts are cut into pieces by the vocabulary's pattern. All new pieces of a batch are laid out in one
row of symbols. An index maps each adjacent pair to all its positions; the pair of the lowest active
rank is merged at all of them from left to right, and only the lists of the pairs beside a merged
place change. A place's entry may be out of date, so each is looked at again before it is merged.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clean_text, table

#: The pieces of byte-level BPE of 50,257 ids; white space as Unicode has it. Fixed values.
PIECES = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Text is worked on in parts of about so many characters, and so many pieces are remembered.
CHUNK_CHARS = 4_000_000
_BITS = 20
_LOW = (1 << _BITS) - 1
#: Symbols that are in no pair: what parts two pieces, and a place that was merged into the one before it.
_WALL, _GONE = _LOW, _LOW - 1
#: Pairs with so many places are merged at all of them in one go.
_MANY = 40
MAX_REMEMBERED = 500_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if it prints, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, extra = [], 256
    for b in range(256):
        letters.append(chr(b if b in shown else extra))
        extra += b not in shown
    return letters


class Vocabulary:
    """Ids, merges and special strings of a tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        ids: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        self.byte_ids = np.array([ids[x] for x in letters], np.int32)
        self.rank: dict[int, int] = {}
        self.merged: dict[int, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair = ids[a] << _BITS | ids[b]
            self.rank.setdefault(pair, rank)
            self.merged.setdefault(pair, ids[a + b])
        keys = np.array(list(self.rank), np.int64)
        ranks = np.array(list(self.rank.values()), np.int64)
        order = np.argsort(keys)
        self.pairs, self.pair_ranks = keys[order], ranks[order]
        self.pair_of_rank = dict(zip(self.rank.values(), self.rank))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        to_byte = {x: b for b, x in enumerate(letters)}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        pieces = [b""] * self.size
        for token, i in ids.items():
            pieces[i] = bytes(to_byte[x] for x in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.lengths = np.array([len(x) for x in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def ranks_of(self, pairs: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it is no merge."""
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.pair_ranks[at], -1)


class PairIndex:
    """All positions of each adjacent pair of a row of symbols; pieces are parted by walls."""

    def __init__(self, pieces: list[bytes], vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        sizes = np.array([len(p) for p in pieces], np.int64)
        self.walls = np.cumsum(sizes + 1) - 1
        start = vocabulary.byte_ids[raw]
        start[self.walls] = _WALL
        n = len(raw)
        # plain arrays for single places, with views for many at once
        self.symbol, self.left, self.right = array("i", start.tobytes()), array("i", np.arange(-1, n - 1, dtype=np.int32).tobytes()), array("i", np.arange(1, n + 1, dtype=np.int32).tobytes())
        self.symbols, self.lefts, self.rights = (np.frombuffer(x, np.int32) for x in (self.symbol, self.left, self.right))
        self.places: dict[int, list[int]] = {}
        self.many: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []
        self._enter(vocabulary.ranks_of(start[:-1].astype(np.int64) << _BITS | start[1:]), np.arange(n - 1))

    def _enter(self, ranks: np.ndarray, at: np.ndarray) -> None:
        """Add places to the lists of their pairs; a rank of -1 is no merge."""
        some = ranks >= 0
        ranks, at = ranks[some], at[some]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        begin = np.flatnonzero(np.diff(ranks, prepend=-1))
        for rank, part in zip(ranks[begin].tolist(), np.split(at, begin[1:])):
            if rank in self.many:
                self.many[rank].append(part)
            else:
                self.many[rank] = [part]
                if rank not in self.places:
                    heapq.heappush(self.heap, rank)

    def _add(self, rank: int, at: int) -> None:
        own = self.places.get(rank)
        if own is not None:
            own.append(at)
        else:
            self.places[rank] = [at]
            if rank not in self.many:
                heapq.heappush(self.heap, rank)

    def merge_all(self) -> None:
        """Merge the active pair of the lowest rank until there is none."""
        while self.heap:
            rank = heapq.heappop(self.heap)
            few, many = self.places.pop(rank, []), self.many.pop(rank, [])
            pair = self.vocabulary.pair_of_rank[rank]
            a, b = pair >> _BITS, pair & _LOW
            if many:
                if few:
                    many.append(np.array(few, np.int64))
                at = np.unique(np.concatenate(many)) if len(many) > 1 else many[0]
                if a != b and len(at) >= _MANY and self._merge_many(rank, a, b, at):
                    continue
                few = at.tolist()
            elif len(few) > 1:
                few.sort()
            self._merge_few(rank, a, b, few)

    def _merge_many(self, rank: int, a: int, b: int, at: np.ndarray) -> bool:
        """Merge places of a pair of unlike symbols at once; False if a lower rank comes up between them."""
        symbols, lefts, rights = self.symbols, self.lefts, self.rights
        at = at[symbols[at] == a]
        gone = rights[at]
        still = symbols[gone] == b
        at, gone = at[still], gone[still]
        new = self.vocabulary.merged[a << _BITS | b]
        after, before = rights[gone], lefts[at]
        of = self.vocabulary.ranks_of
        ranks = of(np.int64(new) << _BITS | symbols[after])
        prior = np.where(before >= 0, symbols[before], _WALL).astype(np.int64)
        ranks_before = of(prior << _BITS | new)
        if ((ranks >= 0) & (ranks < rank)).any() or ((ranks_before >= 0) & (ranks_before < rank)).any():
            return False
        symbols[at] = new
        symbols[gone] = _GONE
        rights[at] = after
        lefts[after] = at
        # a neighbour may have been merged as well
        beside = symbols[after]
        if (beside == new).any():
            ranks = of(np.int64(new) << _BITS | beside)
        before = lefts[at]
        twin = (before >= 0) & (symbols[before] == new)
        if twin.any():
            ranks_before = np.where(twin, -1, ranks_before)  # entered from the other side
        self._enter(np.concatenate([ranks, ranks_before]), np.concatenate([at, before]).astype(np.int64))
        return True

    def _merge_few(self, rank: int, a: int, b: int, places: list[int]) -> None:
        symbol, left, right = self.symbol, self.left, self.right
        rank_of, add = self.vocabulary.rank.get, self._add
        new = self.vocabulary.merged[a << _BITS | b]
        as_left = new << _BITS
        for k, at in enumerate(places):
            if symbol[at] != a:
                continue
            gone = right[at]
            if symbol[gone] != b:
                continue
            symbol[at] = new
            symbol[gone] = _GONE
            after = right[at] = right[gone]
            left[after] = at  # there always is one: the wall behind the piece
            lower = False
            found = rank_of(as_left | symbol[after])
            if found is not None:
                add(found, at)
                lower = found < rank
            prior = left[at]
            if prior >= 0:
                found = rank_of(symbol[prior] << _BITS | new)
                if found is not None:
                    add(found, prior)
                    lower = lower or found < rank
            if lower:  # a lower rank is active now: it goes first, the other places wait
                for other in places[k + 1 :]:
                    add(rank, other)
                return

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each piece has."""
        live = self.symbols < _GONE
        total = np.cumsum(live)[self.walls]
        return self.symbols[live], np.diff(total, prepend=0)


def merge_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in a row and the number of each, all merged together through one index."""
    if not pieces:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    index = PairIndex(pieces, vocabulary)
    index.merge_all()
    return index.ids()


class _Numbered(dict):
    """Numbers pieces in the order in which they come up."""

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        return n


class Encoder:
    """Encodes texts round by round and remembers a bounded number of pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PIECES, remember: int = MAX_REMEMBERED):
        self.vocabulary = vocabulary
        self.find = regex.compile(pattern).findall
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.remember = remember
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbered({t: k for k, t in enumerate(self.vocabulary.special)})
        self.ids = np.array(list(self.vocabulary.special.values()), np.int32)
        self.counts = np.ones(len(self.ids), np.int64)

    def _pieces(self, text: str) -> list[str]:
        if self.parts is None or self.parts.search(text) is None:
            return self.find(text)
        out: list[str] = []
        for part in self.parts.split(text):
            out += [part] if part in self.vocabulary.special else self.find(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the number of each text."""
        if len(self.numbers) > self.remember:
            self._forget()
        known = len(self.numbers)
        number = self.numbers.__getitem__
        numbered = [np.fromiter(map(number, own), np.int32, len(own)) for own in map(self._pieces, texts)]
        new, counts = merge_pieces([p.encode() for p in islice(self.numbers, known, None)], self.vocabulary)
        self.ids, self.counts = np.concatenate([self.ids, new]), np.concatenate([self.counts, counts])
        starts = np.cumsum(self.counts) - self.counts
        out, sizes = [], []
        for own in numbered:
            n = self.counts[own]
            total = int(n.sum())
            out.append(self.ids[np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(total)])
            sizes.append(total)
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.array(sizes, np.int64)


def decode_ids(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD."""
    lengths = vocabulary.lengths[ids]
    total = int(lengths.sum())
    begin = np.repeat(vocabulary.starts[ids] - (np.cumsum(lengths) - lengths), lengths)
    return vocabulary.piece_bytes[begin + np.arange(total)].tobytes().decode("utf-8", "replace")


def _chunks(texts: Iterable[str], limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, tokenizer: str, text_col: str = "text", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """Per input row: the columns of ``keep``, ``ids`` (an array of ints), and with ``decoded`` their text.

    ``tokenizer`` is the content of a tokenizer file, which goes to every executor; its size is that of
    a vocabulary. Strings of special tokens in a text become their ids. Null and empty texts have no
    ids; repeated rows are encoded one by one; no text is cut short. With ``decoded`` the ids are
    decoded in the same task, which saves a second trip of all ids to Python.
    """
    keep = keep or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer)
    read = docs.select(*keep, clean_text(F.col(text_col)).alias("_text"))
    own = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(sent.value))
        for batch in batches:
            at = 0
            for texts in _chunks(x.as_py() for x in batch.column("_text")):
                ids, sizes = encoder.encode(texts)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                columns = [*(batch.column(c).slice(at, len(texts)) for c in keep), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))]
                if decoded:
                    columns.append(pa.array([decode_ids(ids[a:b], encoder.vocabulary) for a, b in zip(offsets, offsets[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(f.name for f in own)])
                at += len(texts)
        del encoder
        pa.default_memory_pool().release_unused()

    return read.mapInArrow(run, T.StructType([read.schema[c] for c in keep] + own))


def decode_documents(tokens: DataFrame, tokenizer: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Per input row: the columns of ``keep`` and ``decoded``; null ids give the empty text."""
    keep = keep or ["doc_id"]
    sent = tokens.sparkSession.sparkContext.broadcast(tokenizer)
    read = tokens.select(*keep, F.col(ids_col).alias("_ids"))
    schema = T.StructType([read.schema[c] for c in keep] + [T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(sent.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [decode_ids(np.asarray(x.values, np.int64) if x.is_valid else np.zeros(0, np.int64), vocabulary) for x in part.column("_ids")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return read.mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: doc_id, n_tokens and digests of the ids and of the text decoded from them."""
    tokens = encode_documents(docs, tokenizer, decoded=True)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """The content of a public tokenizer file, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_file())
