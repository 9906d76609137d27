"""Near duplicates by an LSH forest of MinHash signatures.

1. Documents with equal sets of shingles are one set. A set's signature is cut into ``TREES`` labels of ``DEPTH`` values.
2. *Sorted orders.* The labels of each tree are sorted, over all machines. Sets whose labels share a prefix stand next to each
   other, so the neighbours with a longest common prefix of ``SHARE`` values or more join all sets that share one: a
   region. Regions that have a set in common in different trees are one region.
3. *Adaptive depth.* What is compared in a region goes as deep as the region asks: a region is read with its texts, its
   shingles are ordered from rare to frequent, and only sets meet that share one of the first few of them. A region that holds
   more shingles than ``BLOCK`` is cut into blocks first; once their own links are known, only sets outside of the region's
   largest component meet the other blocks.
4. Every pair that meets is confirmed on full sets, unless links join both already: a block gives links that span its
   components, not all its pairs.

Candidates are found with a probability: two sets of similarity 0.85 are missed with one of 4 in ten million, more similar ones
less often. What is linked is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.llm.common import Scratch, shingle_hashes, slices, small_batches, written
from scholion.llm.components import components

WORDS, PERCENT = 3, 85
#: Sorted orders, values of a label (two bytes each), and values that neighbours share at least.
TREES, DEPTH, SHARE = 20, 8, 4
#: Shingles of a block, and of what passes by one (both 8 bytes each); one set may have more.
BLOCK, PASSING = 1 << 19, 1 << 22
#: Up to so many rows (some 60 bytes each) are sent to the scan of the texts; beyond, documents are dealt by id.
BROADCAST_ROWS = 500_000
#: Of rows met before, a task remembers so many.
KNOWN = 100_000
_FACTOR = np.random.default_rng(20250211).integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
_ROWS = 2048


def signature(shingles: np.ndarray) -> bytes:
    """The labels of a set's trees, one after the other: for each value the least of its shingles in an order of its own."""
    low = shingles.astype(np.uint32)
    least = np.full(len(_FACTOR), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), _ROWS):
        least = np.minimum(least, (low[k : k + _ROWS, None] * _FACTOR).min(0))
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2").tobytes()


def _key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signatures(words: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(_id, _x, size, key, signature) of rows (_id, _x, text); no signature for sets too small to link with another one."""
        for part in (part for batch in batches for part in slices(batch, 2)):
            sizes, keys, signs = [], [], []
            for text in part.column(2):
                s = shingle_hashes(text.as_py() or b"", words)
                sizes.append(len(s))
                keys.append(_key(s))
                signs.append(signature(s) if len(s) >= least else None)
            yield pa.record_batch([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], ["_id", "_x", "_n", "_key", "_sig"])

    return run


_EDGE = "_u long, _v long, _o binary"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (_o tree and label, _u) in order: neighbours that share the tree and ``SHARE`` values, and, without a
    neighbour, a task's first and last row, which may go on in another task."""
    share = 1 + 2 * SHARE
    before: tuple[bytes, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        orders, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out = [] if before is not None else [(ids[0], None, orders[0])]
        for o, i in zip(orders, ids, strict=True):
            if before is not None and before[0][:share] == o[:share] and before[1] != i:
                out.append((before[1], i, None))
            before = o, i
        yield _edges(out)
    if before is not None:
        yield _edges([(before[1], None, before[0])])


def _edges(rows: list[tuple]) -> pa.RecordBatch:
    u, v, o = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(o, pa.binary())], ["_u", "_v", "_o"])


class Block:
    """Sets by their shingles, rare ones first, with an index of the first few of each: sets that link share one."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT) -> None:
        self.percent, self.sizes = percent, np.array([len(s) for s in sets], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.names, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.rank = np.empty(len(count), np.int64)
        self.rank[np.argsort(count, kind="stable")] = np.arange(len(count))
        self.ids = self.rank[at]
        self.marked = np.zeros(len(count), bool)
        lists = [np.sort(self.ids[a:b])[: self.first(b - a)] for a, b in zip(self.starts, self.starts[1:], strict=False)]
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in lists])
        key = np.concatenate(lists)
        order = np.argsort(key, kind="stable")
        self.owner, key = owner[order], key[order]
        self.begin = np.searchsorted(key, np.arange(len(count) + 1))

    def first(self, n: int) -> int:
        return n - (self.percent * n + 99) // 100 + 1

    def of(self, i: int) -> np.ndarray:
        return self.ids[self.starts[i] : self.starts[i + 1]]

    def known(self, shingles: np.ndarray) -> np.ndarray:
        """A set's shingles that occur here."""
        at = np.minimum(np.searchsorted(self.names, shingles), len(self.names) - 1)
        return self.rank[at[self.names[at] == shingles]]

    def candidates(self, ids: np.ndarray, size: int) -> np.ndarray:
        """Sets that may link to one of that size which has ``ids`` here; what it has beyond them comes first in the order."""
        ids = np.sort(ids)[: max(0, self.first(size) - (size - len(ids)))]
        lists = [self.owner[self.begin[k] : self.begin[k + 1]] for k in ids.tolist()]
        found = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64)
        return found[(100 * self.sizes[found] >= self.percent * size) & (100 * size >= self.percent * self.sizes[found])]

    def linked(self, ids: np.ndarray, size: int, found: np.ndarray) -> np.ndarray:
        """Of the sets ``found``, those that link."""
        if not len(found):
            return found
        self.marked[ids] = True
        shared = np.array([np.count_nonzero(self.marked[self.of(k)]) for k in found.tolist()], np.int64)
        self.marked[ids] = False
        return found[100 * shared >= self.percent * (self.sizes[found] + size - shared)]


class Parts:
    """Disjoint parts of things with a label each; the smaller one is told the label of the larger."""

    def __init__(self, labels: list) -> None:
        names: dict = {}
        self.label = np.array([names.setdefault(x, len(names)) for x in labels], np.int64)
        self.names = names
        self.members = [np.flatnonzero(self.label == k) for k in range(len(names))] if len(names) < len(labels) else list(np.arange(len(labels))[:, None])

    def join(self, a: int, b: int) -> None:
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.label[self.members[b]] = a
        self.members[a], self.members[b] = np.concatenate([self.members[a], self.members[b]]), self.members[b][:0]


def links_inside(sets: list[np.ndarray], percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """Pairs of places in ``sets`` whose links span the components."""
    if len(sets) < 2:
        return
    block, parts = Block(sets, percent), Parts(list(range(len(sets))))
    for i in range(1, len(sets)):
        ids, size = block.of(i), int(block.sizes[i])
        found = block.candidates(ids, size)
        found = found[found < i]
        while len(found := found[parts.label[found] != parts.label[i]]):
            # The last few first: in a group of copies, most of the others are in the same part then.
            for k in block.linked(ids, size, found[-16:]).tolist():
                if parts.label[k] != parts.label[i]:
                    parts.join(int(parts.label[k]), int(parts.label[i]))
                    yield k, i
            found = found[:-16]


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without those that a task met before with the same place, document and key (columns up to the text)."""
    seen: set[tuple] = set()
    for batch in batches:
        keep = []
        for row in zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True):
            keep.append(row not in seen)
            seen.add(row)
        if len(seen) > KNOWN:
            seen.clear()
        yield batch.filter(pa.array(keep, pa.bool_()))


_PLACE = "_g long, _b long, _o long, _side int, _c long, _rep long, _key binary"
_AT = ["_g", "_b", "_o", "_side", "_c", "_rep", "_key"]


def _met(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[tuple, int, int, int, np.ndarray]]:
    """(place, side, component, document, set) of sorted rows (_PLACE, text), each once, if the text is the one that is meant."""
    last = None
    for batch in batches:
        for g, b, o, side, c, rep, key, text in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.column(len(_AT)), strict=True):
            if last == (g, b, o, side, rep, key):
                continue
            s = shingle_hashes(text.as_py() or b"", words)
            if _key(s) == key:
                last = g, b, o, side, rep, key
                yield (g, b, o), side, c, rep, s


def _inside(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of each block."""
        held, ids, sets = None, [], []

        def out() -> pa.RecordBatch:
            return _edges([(ids[a], ids[b], None) for a, b in links_inside(sets, percent)])

        for place, _, _, rep, s in _met(batches, words):
            if place != held:
                if sets:
                    yield out()
                held, ids, sets = place, [], []
            ids.append(rep)
            sets.append(s)
        if sets:
            yield out()

    return run


def _across(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of a block's sets (side 0) with those that pass by (side 1), of different components."""
        held, ids, labels, sets, block, parts = None, [], [], [], None, None
        links: list[tuple] = []
        joined: set[tuple[int, int]] = set()  # components that a link joins already
        for place, side, c, rep, s in _met(batches, words):
            if place != held:
                held, ids, labels, sets, block = place, [], [], [], None
                yield _edges(links)
                links, joined = [], set()
            if side == 0:
                ids.append(rep)
                labels.append(c)
                sets.append(s)
                continue
            if block is None:
                block, parts = (Block(sets, percent), Parts(labels)) if sets else (None, None)
            if block is None:
                continue
            own = block.known(s)
            found = block.candidates(own, len(s))
            found = found[parts.label[found] != parts.names.get(c, -1)]
            for k in block.linked(own, len(s), found).tolist():
                if (int(parts.label[k]), c) not in joined:
                    joined.add((int(parts.label[k]), c))
                    links.append((ids[k], rep, None))
        yield _edges(links)

    return run


def _confirmed(wanted: DataFrame, docs: DataFrame, run, scratch: Scratch) -> DataFrame:
    """Links (_u, _v) of rows (_PLACE, _rx) that say which texts meet where."""
    small = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    with small_batches(docs.sparkSession):
        texts = docs.join(small, (F.col("_id") == F.col("_rep")) & (F.col("_x") == F.col("_rx"))).select(*_AT, "_text").mapInArrow(_fresh, f"{_PLACE}, _text binary")
        return scratch.written(texts.repartition("_g", "_b", "_o").sortWithinPartitions("_g", "_b", "_o", "_side", "_rep", "_key").mapInArrow(run, _EDGE).select("_u", "_v"), "links")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, block: int = BLOCK, passing: int = PASSING) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``df``.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A set holds a text's distinct shingles of ``words`` words, or its
    whole word sequence as one if there are fewer; a null text or one without words has an empty set, links with nothing and is its own
    component. Sets link when 100 times their intersection is at least ``percent`` times their union. ``component_id``
    is the smallest id reachable by links, and a row is ``kept`` if it is its own.

    Ids are integers; a row without one takes no part, has a null component and is kept. Rows that repeat an id are one document with
    several texts, linked by any of them. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession)
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62
    docs = df.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col)).alias("_x"), F.col(text_col).cast("binary").alias("_text"))
    with small_batches(df.sparkSession):
        read = written(docs.mapInArrow(_signatures(words, least), "_id long, _x long, _n long, _key binary, _sig binary"), "signatures")
    first = read.filter("_n > 0 and _id is not null").groupBy("_key").agg(F.min(F.struct("_id", "_x")).alias("_r"), F.min("_n").alias("_n"), F.min("_sig").alias("_sig"))
    sets = scratch.written(first.select(F.col("_r._id").alias("_rep"), F.col("_r._x").alias("_rx"), "_key", "_n", "_sig"), "sets")

    label = F.concat(F.unhex(F.lpad(F.hex("_t"), 2, "0")), F.substring(F.col("_sig"), F.col("_t") * (2 * DEPTH) + 1, F.lit(2 * DEPTH)))
    trees = sets.filter("_sig is not null").withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).select(label.alias("_o"), F.col("_rep").alias("_u"))
    beside = scratch.written(trees.repartitionByRange("_o", "_u").sortWithinPartitions("_o", "_u").mapInArrow(_neighbours, _EDGE), "neighbours")
    # Two rows of every task at most.
    ends = beside.filter("_v is null").select("_o", "_u").repartition(1).sortWithinPartitions("_o", "_u").mapInArrow(_neighbours, _EDGE)
    regions = components(beside.filter("_v is not null").unionByName(ends.filter("_v is not null")).select(F.col("_u").alias("u"), F.col("_v").alias("v")).distinct())

    members = sets.join(regions, F.col("_rep") == F.col("node")).select("_rep", "_rx", "_key", "_n", F.col("component").alias("_g"))
    members = scratch.written(members, "members")
    blocks = members.groupBy("_g").agg(F.ceil(F.sum("_n") / F.lit(float(block))).alias("_blocks"), F.ceil(F.sum("_n") / F.lit(float(passing))).alias("_ways")).withColumnRenamed("_g", "_k")
    members = scratch.written(members.join(blocks, F.col("_g") == F.col("_k")).drop("_k"), "members")
    none = lambda *names: [F.lit(0).cast("int" if n == "_side" else "long").alias(n) for n in names]
    wanted = scratch.written(members.select("_g", F.pmod(F.xxhash64("_rep"), "_blocks").alias("_b"), *none("_o", "_side", "_c"), "_rep", "_key", "_rx"), "wanted")
    links = _confirmed(wanted, docs, _inside(words, percent), scratch)
    edges = links.select(F.col("_u").alias("u"), F.col("_v").alias("v"))

    large = scratch.written(members.filter("_blocks > 1"), "large")
    if not large.isEmpty():
        edges = edges.unionByName(_between_blocks(large, edges, docs, block, _across(words, percent), scratch))
    # An id with several texts joins their sets.
    texts = read.filter("_n > 0 and _id is not null")
    several = texts.groupBy("_id").agg(F.min("_key").alias("_lo"), F.max("_key").alias("_hi")).filter("_lo <> _hi").select(F.col("_id").alias("_i"))
    several = texts.join(several, F.col("_id") == F.col("_i")).select("_id", F.col("_key").alias("_k")).distinct()
    edges = edges.unionByName(several.join(sets, F.col("_k") == F.col("_key")).select(F.col("_id").alias("u"), F.col("_rep").alias("v")))
    final = components(edges).withColumnRenamed("node", "_node")
    named = written(sets.join(final, F.col("_rep") == F.col("_node"), "left").select(F.col("_key").alias("_k"), F.coalesce("component", "_rep").alias("_c")), "named")
    scratch.clear()
    out = read.select("_id", "_n", "_key").join(named, F.col("_key") == F.col("_k"), "left").withColumn("_c", F.when(F.col("_id").isNotNull(), F.coalesce("_c", "_id")))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_c").alias("component_id"), F.col("_id").eqNullSafe(F.col("_c")).alias("kept"))


def _between_blocks(large: DataFrame, edges: DataFrame, docs: DataFrame, block: int, run, scratch: Scratch) -> DataFrame:
    """Links between blocks of a region: its sets outside of its largest component, in blocks, by which all its sets pass."""
    known = components(edges)
    large = large.join(known, F.col("_rep") == F.col("node"), "left").select("_g", "_rep", "_rx", "_key", "_n", "_ways", F.coalesce("component", "_rep").alias("_c"))
    large = scratch.written(large, "large")
    main = large.groupBy("_g", "_c").agg(F.sum("_n").alias("_s")).groupBy("_g").agg(F.max(F.struct("_s", "_c")).alias("_m")).select(F.col("_g").alias("_k"), F.col("_m._c").alias("_main"))
    outer = large.join(main, F.col("_g") == F.col("_k")).filter("_c <> _main").drop("_k", "_main")
    sizes = outer.groupBy("_g").agg(F.ceil(F.sum("_n") / F.lit(float(block))).alias("_outer")).withColumnRenamed("_g", "_k")
    sizes = scratch.written(sizes, "outer")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held = outer.join(sizes, F.col("_g") == F.col("_k")).withColumn("_b", F.pmod(F.xxhash64("_rep"), "_outer")).withColumn("_o", upto("_ways")).withColumn("_side", F.lit(0))
    pass_by = large.join(sizes, F.col("_g") == F.col("_k")).withColumn("_b", upto("_outer")).withColumn("_o", F.pmod(F.xxhash64("_rep"), "_ways")).withColumn("_side", F.lit(1))
    wanted = scratch.written(held.select(*_AT, "_rx").unionByName(pass_by.select(*_AT, "_rx")), "wanted")
    return _confirmed(wanted, docs, run, scratch).select(F.col("_u").alias("u"), F.col("_v").alias("v"))
