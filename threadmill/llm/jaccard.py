"""N-gram Jaccard join by prefix trees, and the components of its links.

1. Each document becomes its set of word n-grams (64-bit hashes) in one global order: n-grams that
   are frequent in some part of the corpus come last, by count, all others first, by hash. Documents
   of equal sets form a class, which goes on as one.
2. Two sets can link only if their prefixes (the first n - ceil(t n) + 1 n-grams) share one. Classes
   meet by prefix n-gram; a length bound and a parity sketch, which bounds the symmetric difference
   from below, leave out pairs that cannot link. What remains ties classes into candidate groups.
   An n-gram of very many classes ties them all at once, without a look at their sketches.
3. Each group's whole sets are joined in a prefix tree: a set is traced down the tree, sharing the
   overlap so far with all sets below a node, and a subtree is left as soon as its remaining lengths
   cannot give the similarity. At a set's end the overlap is exact, and so is the link.
4. A large group is dealt into slots, each with a copy of the group's pivots (its most frequent set and two others), and each slot is joined on
   its own. Copies of one text then mostly hang together through the pivots. What doesn't belong to the
   group's largest component by then is looked up in the trees of all its slots. So every pair is either
   compared in a slot, or connected already, or one of it is looked up in the other's slot.

No step depends on luck: order, ties and pivots only decide how much work there is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_SEPARATORS, Words, byte_values, clean_text, cut, key_filter, mix64, passes, row_chunks, separator_mask, table, text_buffer
from .components import connected_components

#: An n-gram is frequent if a part of the corpus has it in so many of its documents.
FREQUENT_SHARE, FREQUENT_LEAST = 0.0005, 6
#: At most so many frequent n-grams are sent to the executors (12 bytes each), the most frequent ones.
MAX_FREQUENT = 1_000_000
#: Counting takes up so many n-grams of a part at a time.
COUNTED_AT_ONCE = 3_000_000
#: An n-gram of so many texts ties all their classes, which are then candidates of each other.
HOT_TEXTS = 5_000
#: A row is compared with so many others of an n-gram; if none may link by then, it is tied all the same. A tie makes a candidate, so no link is lost.
MAX_COMPARED = 2_000
#: A candidate group is dealt into at most this many slots of the smaller number of n-grams, or into as many as keep each at the larger number.
SLOTS, SLOT_LEAST, SLOT_MOST = 64, 15_000, 4_000_000
#: The places of the sets in their groups are broadcast up to so many rows (about 50 bytes each), else joined by shuffle.
MAX_BROADCAST_ROWS = 500_000
_SPACE = separator_mask(SPACE_SEPARATORS)
_VALUES = byte_values(lower=True)


def ngram_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct n-gram hashes of each text; a text of fewer words is one n-gram."""
    raw, offsets = text_buffer(column)
    odd = [np.uint64(2 * k + 3) for k in range(n)]
    for lo, hi in row_chunks(offsets):
        words = Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], _SPACE, _VALUES)
        counts = words.counts()
        ends = np.cumsum(counts)
        grams = words.hash[: max(0, len(words.hash) - n + 1)] * odd[0]
        for k in range(1, n):
            grams = mix64(grams) + words.hash[k : len(words.hash) - n + 1 + k] * odd[k]
        grams = mix64(grams)
        for row, (end, count) in enumerate(zip(ends, counts)):
            if count >= n:
                yield lo + row, np.unique(grams[end - count : end - n + 1])
            elif count:
                whole = np.array([count], np.uint64)
                for k in range(end - count, end):
                    whole = mix64(whole ^ words.hash[k : k + 1]) * odd[0]
                yield lo + row, whole
            else:
                yield lo + row, np.zeros(0, np.uint64)


def _frequent(read: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent n-grams, sorted, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = docs = 0

        def flush() -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = counts >= max(FREQUENT_LEAST, FREQUENT_SHARE * docs)
            return pa.RecordBatch.from_arrays([pa.array(grams[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["gram", "n"])

        for batch in batches:
            for _, grams in ngram_sets(batch.column("text"), n):
                held.append(grams)
                size += len(grams)
                docs += 1
                if size >= COUNTED_AT_ONCE:
                    yield flush()
                    held, size, docs = [], 0, 0
        yield flush()

    counted = read.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "gram").limit(MAX_FREQUENT).toArrow()
    grams = top.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], top.column("n").to_numpy()[order]


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def ordered_prefix(grams: np.ndarray, length: int, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n-grams of a sorted set in the global order."""
    if not len(frequent):
        return grams[:length]
    at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
    often = frequent[at] == grams
    rare = grams[~often]
    if len(rare) >= length:
        return rare[:length]
    rest, n = grams[often], counts[at[often]]
    return np.concatenate([rare, rest[np.lexsort((rest, n))][: length - len(rare)]])


def sketch_bits(n: int, percent: int) -> int:
    """Bits of the parity sketch of a set of ``n``: a power of two, over twice the difference that a link allows."""
    return max(64, 1 << (24 * 2 * n * (100 - percent) // (100 + percent) // 10).bit_length())


def parity_sketch(grams: np.ndarray, percent: int) -> bytes:
    """Bit i is the parity of the n-grams that hash to i."""
    bits = sketch_bits(len(grams), percent)
    place = (grams >> np.uint64(17)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def may_link(n_a: int, sketch_a: int, n_b: int, sketch_b: int, percent: int) -> bool:
    """False only if the sets surely differ too much; sketches as little-endian numbers."""
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
        return False
    bits_a, bits_b = sketch_bits(n_a, percent), sketch_bits(n_b, percent)
    while bits_a > bits_b:
        bits_a >>= 1
        sketch_a = (sketch_a ^ (sketch_a >> bits_a)) & ((1 << bits_a) - 1)
    while bits_b > bits_a:
        bits_b >>= 1
        sketch_b = (sketch_b ^ (sketch_b >> bits_b)) & ((1 << bits_b) - 1)
    return (sketch_a ^ sketch_b).bit_count() * (100 + percent) <= (100 - percent) * (n_a + n_b)


def _signature(grams: np.ndarray) -> tuple[int, int]:
    a = mix64(grams + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
    b = mix64(grams ^ np.uint64(0x9E6C63D0876A9F4B)).sum(dtype=np.uint64)
    return int(np.int64(a.view(np.int64))), int(np.int64((b + np.uint64(len(grams))).view(np.int64)))


def _profiles(read: DataFrame, n: int, percent: int, keep: list[str], frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row of ``read`` (row, doc_id, text, ``keep``): row, doc_id, ``keep``, n, sig_a, sig_b, prefix, sketch.

    A task gives prefix and sketch of a set once, for the first of its rows that has it.
    """
    sent = read.sparkSession.sparkContext.broadcast(frequent)
    least = -(-percent // (100 - percent)) if percent < 100 else None  # smaller sets link with equal ones alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = sent.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            size, sig_a, sig_b, prefix, sketch = [], [], [], [], []
            for _, grams in ngram_sets(batch.column("text"), n):
                a, b = _signature(grams)
                own = least is not None and len(grams) >= least and (a, b) not in seen
                if own:
                    seen.add((a, b))
                size.append(len(grams))
                sig_a.append(a)
                sig_b.append(b)
                prefix.append(ordered_prefix(grams, prefix_length(len(grams), percent), frequent, counts).view(np.int64) if own else np.zeros(0, np.int64))
                sketch.append(parity_sketch(grams, percent) if own else None)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), *(batch.column(c) for c in keep), pa.array(size, pa.int64()), pa.array(sig_a, pa.int64()), pa.array(sig_b, pa.int64()), lists, pa.array(sketch, pa.binary())],
                names=["row", "doc_id", *keep, "n", "sig_a", "sig_b", "prefix", "sketch"],
            )

    kinds = "".join(f"`{c}` {read.schema[c].dataType.simpleString()}, " for c in ["doc_id", *keep])
    return read.mapInArrow(run, f"row long, {kinds}n long, sig_a long, sig_b long, prefix array<long>, sketch binary")


def _sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[list[tuple]]:
    """The rows of each key of sorted batches, where a key has more than one."""
    held: list[tuple] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changes = np.zeros(batch.num_rows, bool)
        for v in values:
            changes[1:] |= v[1:] != v[:-1]
        begin = np.append(0, np.flatnonzero(changes))
        end = np.append(begin[1:], batch.num_rows)
        for b, e in zip(begin.tolist(), end.tolist()):
            key = tuple(int(v[b]) for v in values)
            inner = 0 < b and e < batch.num_rows
            if inner and e - b == 1:
                if len(held) > 1:
                    yield held
                held, now = [], None
                continue
            if key != now:
                if len(held) > 1:
                    yield held
                held, now = [], key
            held += zip(*(batch.column(c).slice(b, e - b).to_pylist() for c in columns))
    if len(held) > 1:
        yield held


class Union:
    """Disjoint sets of small integers; the least member is the root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def tie_candidates(group: list[tuple[int, int, bytes]], percent: int, most: int = MAX_COMPARED) -> list[tuple[int, int]]:
    """Edges that tie the rows (row, n, sketch) of a prefix n-gram which may link, at most one a row and set of tied rows.

    A row is compared with the rows of each set of tied rows until one may link: those are tied anyway.
    After ``most`` comparisons it is tied to the next set without one.
    """
    rows = sorted(set(group), key=lambda r: (r[1], r[0]))
    tied: list[list[tuple[int, int, int]]] = []
    edges: list[tuple[int, int]] = []
    for row, n, sketch in rows:
        own = (row, n, int.from_bytes(sketch, "little"))
        hit, rest, left = None, [], most
        for members in tied:
            if 100 * members[-1][1] < percent * n:
                continue  # all of them are too short for this and every later row
            other = None
            for m in reversed(members):
                if 100 * m[1] < percent * n:
                    break  # in the order of their lengths: the rest is shorter still
                left -= 1
                if left < 0 or may_link(m[1], m[2], n, own[2], percent):
                    other = m
                    break
            if other is None:
                rest.append(members)
                continue
            edges.append((other[0], row))
            if hit is None:
                hit = members
                rest.append(hit)
            else:
                hit += members
                hit.sort(key=lambda m: m[1])
        if hit is None:
            rest.append([own])
        else:
            hit.append(own)
        tied = rest
    return edges


_EDGE = "a long, b long"


def _edge_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())], names=["a", "b"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of sorted (gram, row) batches whose gram occurs more than once."""
    grams, rows, kept = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for batch in batches:
        grams, rows = (np.concatenate([held, batch.column(c).to_numpy()]) for held, c in ((grams, "gram"), (rows, "row")))
        if not len(grams):
            continue
        same = grams[1:] == grams[:-1]
        keep = np.zeros(len(grams), bool)
        keep[0] = kept
        keep[1:] |= same
        keep[:-1] |= same
        yield pa.RecordBatch.from_arrays([pa.array(grams[:-1][keep[:-1]]), pa.array(rows[:-1][keep[:-1]])], names=["gram", "row"])
        grams, rows, kept = grams[-1:], rows[-1:], bool(keep[-1])  # the next batch decides on the last row
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(rows)], names=["gram", "row"])


def _candidates(profiles: DataFrame, classes: DataFrame, percent: int, hot: np.ndarray) -> DataFrame:
    """Edges (a, b) between classes that may link.

    Most prefix n-grams have one set alone: they are left out before the sketches come in. The n-grams of
    ``hot`` go another way: their classes are tied to the least one of each, by an aggregate.
    """
    keyed = profiles.select(F.explode("prefix").alias("gram"), "row")
    ties = None
    if len(hot):
        spark = profiles.sparkSession
        listed = F.broadcast(spark.createDataFrame(pa.table({"gram": pa.array(hot.view(np.int64))})))
        frequent = cut(keyed.join(listed, "gram", "left_semi").join(classes.select("row"), "row", "left_semi"))
        anchors = frequent.groupBy("gram").agg(F.min("row").alias("anchor"))
        ties = frequent.join(F.broadcast(anchors), "gram").where("row <> anchor").select(F.col("anchor").alias("a"), F.col("row").alias("b"))
        keyed = keyed.join(listed, "gram", "left_anti")
    shared = keyed.repartition("gram").sortWithinPartitions("gram").mapInArrow(_shared, "gram long, row long")
    sketched = shared.join(classes.select("row", "n", "sketch"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for group in _sorted_groups(batches, ["gram"], ["row", "n", "sketch"]):
            found += tie_candidates(group, percent)
            if len(found) > 20_000:
                yield _edge_batch(found)
                found = []
        yield _edge_batch(found)

    edges = sketched.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, _EDGE)
    return (edges if ties is None else edges.unionByName(ties)).distinct()


class _Node:
    __slots__ = ("seg", "children", "least", "most", "end", "tied")

    def __init__(self, seg: np.ndarray, size: int, end: int | None, tied: int | None):
        self.seg, self.children, self.least, self.most, self.end, self.tied = seg, {}, size, size, end, tied


_MIXED = -1


class PrefixTree:
    """Sets in one order, as paths of a tree whose nodes hold runs of elements."""

    def __init__(self, union: Union, percent: int, universe: int):
        self.root = _Node(np.zeros(0, np.int64), 0, None, None)
        self.union, self.percent = union, percent
        self.mask = np.zeros(universe, bool)

    def link(self, x: np.ndarray, who: int) -> int:
        """Unite ``who`` with every stored set that is similar enough; returns how many nodes were looked at."""
        percent, find, mask, size = self.percent, self.union.find, self.mask, len(x)
        mask[x] = True
        stack = [(c, 0, 0) for c in self.root.children.values()]
        looked = 0
        while stack:
            node, overlap, depth = stack.pop()
            if node.tied != _MIXED and find(node.tied) == find(who):
                continue  # all sets below are linked to this one already
            if 100 * node.most < percent * size or 100 * size < percent * node.least:
                continue
            looked += 1
            overlap += int(mask[node.seg].sum())
            depth += len(node.seg)
            passed = int(np.searchsorted(x, node.seg[-1], "right"))
            if (passed + depth - 2 * overlap) * (100 + percent) > (100 - percent) * (size + node.most):
                continue
            if (overlap + min(size - passed, node.most - depth)) * (100 + percent) < percent * (size + node.least):
                continue
            if node.end is not None and 100 * overlap >= percent * (size + depth - overlap):
                self.union.join(who, node.end)
            stack += [(c, overlap, depth) for c in node.children.values()]
        mask[x] = False
        return looked

    def add(self, x: np.ndarray, who: int) -> None:
        node, at = self.root, 0
        while True:
            if at == len(x):
                node.end = who
                return
            child = node.children.get(int(x[at]))
            if child is None:
                node.children[int(x[at])] = _Node(x[at:], len(x), who, who)
                return
            m = min(len(child.seg), len(x) - at)
            differ = np.flatnonzero(child.seg[:m] != x[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(child.seg):
                upper = _Node(child.seg[:same], child.least, None, child.tied)
                upper.most = child.most
                child.seg = child.seg[same:]
                upper.children[int(child.seg[0])] = child
                node.children[int(x[at])] = upper
                child = upper
            child.least, child.most = min(child.least, len(x)), max(child.most, len(x))
            if child.tied != _MIXED and self.union.find(child.tied) != self.union.find(who):
                child.tied = _MIXED
            node, at = child, at + same


def _ranked(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The sets as sorted ranks of their elements, and how many elements there are. Shared elements come first: paths are shared longest."""
    elements, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(elements), np.int64)
    rank[np.lexsort((elements, -counts))] = np.arange(len(elements))
    return [np.sort(x) for x in np.split(rank[inverse], np.cumsum([len(s) for s in sets])[:-1])], len(elements)


def join_sets(sets: list[np.ndarray], percent: int) -> Union:
    """The links among some sets of distinct elements, as disjoint sets of their numbers."""
    union = Union(len(sets))
    ranks, universe = _ranked(sets)
    tree = PrefixTree(union, percent, universe)
    for who in sorted(range(len(sets)), key=lambda i: (len(sets[i]), i)):
        tree.link(ranks[who], who)
        tree.add(ranks[who], who)
    return union


def look_up(sets: list[np.ndarray], queries: list[np.ndarray], labels: list[int], percent: int) -> list[tuple[int, int]]:
    """Pairs of labels that links between ``queries`` and ``sets`` connect; ``labels`` are those of the sets, then of the queries.

    Sets of one label are connected already and are not compared with each other.
    """
    union = Union(len(sets) + len(queries))
    first: dict[int, int] = {}
    for i, label in enumerate(labels):
        union.join(first.setdefault(label, i), i)
    ranks, universe = _ranked([*sets, *queries])
    tree = PrefixTree(union, percent, universe)
    for who in sorted(range(len(sets)), key=lambda i: (len(sets[i]), i)):
        tree.add(ranks[who], who)
    for who in range(len(sets), len(ranks)):
        tree.link(ranks[who], who)
    return [(labels[i], labels[union.find(i)]) for i in first.values() if labels[union.find(i)] != labels[i]]


def _needed_sets(read: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """(sig_a, sig_b, grams) of the texts whose signature is in ``needed``, and perhaps of some more.

    The signatures go to the executors as a bit filter of fixed size. Each task passes on a set once.
    """
    sent = read.sparkSession.sparkContext.broadcast(key_filter(needed, "sig_a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = sent.value, set()
        for batch in batches:
            found = []
            for _, grams in ngram_sets(batch.column("text"), n):
                a, b = _signature(grams)
                if (a, b) not in seen and passes(wanted, np.array([a]))[0]:
                    seen.add((a, b))
                    found.append((a, b, grams.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.binary())], names=["sig_a", "sig_b", "grams"])

    return read.select("text").mapInArrow(run, "sig_a long, sig_b long, grams binary")


@dataclass(frozen=True)
class Slots:
    """How candidate groups are dealt: into at most ``most`` slots of ``least_grams``, or as many as keep each at ``most_grams``."""

    most: int = SLOTS
    least_grams: int = SLOT_LEAST
    most_grams: int = SLOT_MOST


def _held(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Key and rows of each run of equal keys in sorted batches; rows of the same node, which come together, once."""
    now, held, last = None, [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != now:
                if held:
                    yield now, held
                now, held, last = key, [], None
            this = (row["node"], row.get("own"))
            if this != last:
                held.append(row)
                last = this
    if held:
        yield now, held


_FIRST = "component long, slots int, slot int, node long, root long, own boolean"


def _links(read: DataFrame, profiles: DataFrame, classes: DataFrame, percent: int, n: int, hot: np.ndarray, deal: Slots) -> DataFrame:
    """(node, component): every class that links with another one."""
    groups = connected_components(_candidates(profiles, classes, percent, hot))
    members = cut(groups.join(classes.select(F.col("row").alias("node"), "n", "sig_a", "sig_b", "n_texts"), "node"))
    by_hash = F.xxhash64("node")
    pivots = F.array_distinct(F.array(F.max_by("node", F.struct("n_texts", -F.col("node"))), F.max_by("node", by_hash), F.min_by("node", by_hash)))
    n_slots = F.greatest(F.ceil(F.sum("n") / deal.most_grams), F.least(F.lit(deal.most), F.ceil(F.sum("n") / deal.least_grams))).cast("int")
    large = cut(members.groupBy("component").agg(n_slots.alias("slots"), pivots.alias("pivots")).where("slots > 1"))
    n_large, copies = large.agg(F.count("*"), F.coalesce(F.sum(F.col("slots") * F.size("pivots")), F.lit(0))).first()
    small = lambda df: F.broadcast(df) if n_large <= MAX_BROADCAST_ROWS else df
    placed = members.join(small(large), "component", "left").withColumn("slots", F.coalesce("slots", F.lit(1)))
    columns = ["component", "slots", "slot", "node", "own", "sig_a", "sig_b"]
    own = placed.withColumn("slot", F.pmod(F.xxhash64("node", F.lit(1)), F.col("slots")).cast("int")).withColumn("own", F.lit(True))
    copied = placed.where("array_contains(pivots, node)").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).withColumn("own", F.lit(False))
    tasks = own.select(*columns).unionByName(copied.select(*columns))
    tasks = F.broadcast(tasks) if members.count() + copies <= MAX_BROADCAST_ROWS else tasks
    fetched = tasks.join(_needed_sets(read, members, n), ["sig_a", "sig_b"]).select("component", "slots", "slot", "node", "own", "grams")

    def join_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (component, slots, slot), rows in _held(batches, ["component", "slots", "slot"]):
            sets = {r["node"]: r["grams"] for r in rows}
            nodes = sorted(sets)
            union = join_sets([np.frombuffer(sets[i], np.uint64) for i in nodes], percent)
            own = {r["node"] for r in rows if r["own"]}
            found = [(i, nodes[union.find(k)], i in own) for k, i in enumerate(nodes) if slots > 1 or union.find(k) != k]
            for lo in range(0, len(found), 2000):
                part = found[lo : lo + 2000]
                fixed = [pa.array([x] * len(part), t) for x, t in ((component, pa.int64()), (slots, pa.int32()), (slot, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*fixed, *(pa.array([f[c] for f in part], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.bool_())))], names=["component", "slots", "slot", "node", "root", "own"])

    order = ["component", "slots", "slot", "node", "own"]
    first = cut(fetched.repartition("component", "slot").sortWithinPartitions(*order).mapInArrow(join_slots, _FIRST))
    alone = first.where("slots = 1").select("node", F.col("root").alias("component"))
    alone = alone.unionByName(alone.select(F.col("component").alias("node"), "component").distinct())
    if not n_large:
        return alone
    fetch = lambda some: _needed_sets(read, some, n)
    return alone.unionByName(_between_slots(first.where("slots > 1"), members, fetch, percent, deal, small))


def _between_slots(first: DataFrame, members: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, deal: Slots, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of all classes of large groups, whose slots were joined on their own.

    Sets are worked out once more, for the groups that are not one component yet: that is cheaper than to
    write them all the first time.
    """
    labels = connected_components(first.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("component", "label")
    own = first.where("own").drop("root", "own").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = own.groupBy("component", "label").agg(F.count("*").alias("n"))
    most = counts.groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    labelled = cut(own.join(small(most), "component").join(members.select("node", "n", "sig_a", "sig_b"), "node"))
    others = labelled.where("label <> main")
    blocks = cut(others.groupBy("component").agg(F.ceil(F.sum("n") / deal.most_grams).cast("int").alias("blocks")))
    if blocks.isEmpty():
        return labelled.select("node", F.col("label").alias("component"))
    asked = (
        others.join(small(blocks), "component").withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int"))
        .withColumn("_to", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).where("_to <> slot").withColumn("slot", F.col("_to")).withColumn("is_query", F.lit(True))
    )
    there = labelled.join(small(blocks), "component").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("is_query", F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _held(batches, ["component", "slot", "block"]):
            sets, queries = ([r for r in rows if r["is_query"] is x] for x in (False, True))
            if sets and queries:
                grams = [[np.frombuffer(r["grams"], np.uint64) for r in part] for part in (sets, queries)]
                yield _edge_batch(look_up(*grams, [r["label"] for r in (*sets, *queries)], percent))

    order = ["component", "slot", "block", "is_query", "node"]
    columns = [*order, "label", "sig_a", "sig_b"]
    tasks = cut(there.select(*columns).unionByName(asked.select(*columns)))
    sent = F.broadcast(tasks) if tasks.count() <= MAX_BROADCAST_ROWS else tasks
    fetched = sent.join(fetch(tasks), ["sig_a", "sig_b"]).drop("sig_a", "sig_b")
    found = connected_components(fetched.repartition("component", "slot", "block").sortWithinPartitions(*order).mapInArrow(run, _EDGE))
    named = labelled.select("node", "label").join(found.select(F.col("node").alias("label"), F.col("component").alias("_whole")), "label", "left")
    return named.select("node", F.coalesce("_whole", "label").alias("component"))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", text_key: bool = False, deal: Slots = Slots(), hot_texts: int = HOT_TEXTS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, and with ``text_key`` a hash of the text.

    Texts link if the Jaccard similarity of their n-gram sets is at least ``percent`` hundredths, and
    equal sets always do. ``component_id`` is the least id reachable by links. A text of fewer words
    than ``n`` is one n-gram; a null or empty one has none, links with nothing and is its own
    component. Repeated rows are members of one class. A null id is carried along but names no
    component while there is another one. A very long text is one set, held by one task at a time.
    Other columns are ignored, whatever their names. An empty table gives no rows.

    ``deal`` says how large candidate groups are split, ``hot_texts`` from how many texts on an n-gram's
    classes are tied without a look at them. Neither changes the result.
    """
    keep = ["text_key"] if text_key else []
    text = clean_text(F.col(text_col))
    read = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *[F.xxhash64(text).alias(c) for c in keep])
    frequent, counts = _frequent(read, n)
    profiles = cut(_profiles(read.withColumn("row", F.monotonically_increasing_id()), n, percent, keep, (frequent, counts)))
    some = profiles.where("n > 0")
    classes = some.groupBy("sig_a", "sig_b").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least_id"), F.count("*").alias("n_texts"))
    firsts = cut(some.drop("doc_id", "prefix", *keep).join(classes.select("rep", "least_id", "n_texts"), F.col("row") == F.col("rep")).drop("rep"))
    linked = _links(read, profiles, firsts, percent, n, frequent[counts >= hot_texts], deal)
    ids = firsts.select(F.col("row").alias("node"), "sig_a", "sig_b", "least_id")
    linked = cut(ids.join(linked, "node"))
    least = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = linked.join(least, "component").select("node", "component_id")
    by_class = ids.join(named, "node", "left").select("sig_a", "sig_b", F.coalesce("component_id", "least_id").alias("component_id"))
    out = some.select("doc_id", *keep, "n", "sig_a", "sig_b").join(by_class, ["sig_a", "sig_b"]).select("doc_id", *keep, F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(profiles.where("n = 0").select("doc_id", *keep, F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE
    WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 90 * (nx.n + ny.n - i)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, y FROM reach JOIN edges ON r = x)
SELECT reach.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id
"""
