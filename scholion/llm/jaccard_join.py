"""N-gram Jaccard join with set-relation skipping.

Documents are sets of word shingles; two link when their Jaccard similarity reaches 3/4; the result is
each document's component of links. The join is exact:

1. Equal sets are one set (its *representative*), so copies are never compared.
2. Shingles have one global order, frequent ones last, and each set is indexed under its first
   quarter: sets that link share one of those. An index list's entries carry size and position, from
   which follows how much the two sets can share at all; pairs that cannot reach it are skipped.
3. *Index level.* Every set is first compared only with the leading set of its first few lists, another
   set from list to list. Of the
   pairs, those are skipped that share too few of their indexed shingles. What links is one component.
4. *Answer level.* Sets of one component have their answer already and are never paired again. A component
   is cut into blocks, each a pivot set and its members' differences from it. Lists now hold blocks,
   and only blocks of different components meet, in lists where their positions can reach. Two blocks whose bitmaps (of
   what all members have, and of what any has) differ in too many bits hold no link; of the others, the
   members that share too few indexed shingles with every member of the other block, or differ in too many bits, are
   skipped before any text moves; a block's answers to a set are derived from the
   pivot's: |X and Y| = |P and Y| - |(P - X) and Y| + |(X - P) and Y|, over the differences alone.

So a group of thousands of near copies costs its size, not its square. Sets are 64-bit hashes of
shingles, and sets are equal when their sizes and 64-bit digests are; texts travel row by row, sorted by the group in
which they meet, so that a task holds one side of one group, at most 64 documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholion.llm.common import Scratch, shingle_hashes, slices, small_batches, written
from scholion.llm.components import components

WORDS = 5
#: How many frequent shingles have a place of their own in the order; the others come before, by hash.
FREQUENT = 1 << 17
#: The lists in which a set meets the leading set, and the members of a block.
LEADERS, MEMBERS = 8, 64
#: Members of smaller blocks that pass by a copy of a block.
WAITING = 4096
#: Of sets met before, a task remembers so many keys.
KNOWN = 50_000
#: Up to so many rows (56 bytes each) are broadcast to fetch texts; beyond, documents are dealt by id.
BROADCAST_ROWS = 500_000


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct hashes (int64) of a text's shingles; one of all words if there are fewer than five."""
    return shingle_hashes((text or "").encode(), WORDS)


def _key(shingles: np.ndarray) -> int:
    return int(np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), np.int64)[0])


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each shingle by its hash, four times as many bits as shingles or more."""
    bits = np.zeros(max(512, 1 << (4 * len(shingles) - 1).bit_length()), bool)
    bits[shingles & (len(bits) - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap with fewer bits: that of the same set."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def differences(x: np.ndarray, y: np.ndarray) -> int:
    """Bits of ``x`` that ``y`` lacks, at the size of the smaller one: at least so many shingles are in x alone."""
    size = min(len(x), len(y))
    return int(np.bitwise_count(_fold(x, size) & ~_fold(y, size)).sum())


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, key and bitmap of every set; with the first row of a slice, the shingles that occur in two
    different sets of the slice or more, and in how many."""
    for part in (part for batch in batches for part in slices(batch, 1)):
        sizes, keys, bits, sets = [], [], [], {}
        for text in part.column(1):
            s = shingle_set(text.as_py())
            sizes.append(len(s))
            keys.append(_key(s))
            bits.append(bitmap(s))
            sets[keys[-1]] = s
        h, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
        often = pa.StructArray.from_arrays([h[n > 1], n[n > 1].astype(np.int64)], ["h", "c"])
        ends = pa.array([0] + [len(often)] * len(keys), pa.int32())
        yield pa.record_batch([part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(ends, often)], ["_id", "_n", "_key", "_bits", "_often"])


def in_order(shingles: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A set in the global order: by hash, then the frequent ones, the most frequent last."""
    if not len(frequent):
        return shingles
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    often = frequent[at] == shingles
    return np.concatenate([shingles[~often], shingles[often][np.argsort(rank[at[often]])]])


def _prefix(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def _index(frequent: np.ndarray, rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Index entries; of equal sets that a task meets, those of one, as far as it remembers them."""
        known: set[tuple[int, int]] = set()
        for part in (part for batch in batches for part in slices(batch, 0)):
            if len(known) > KNOWN:
                known.clear()
            fresh: dict[tuple[int, int], np.ndarray] = {}
            for text in part.column(0):
                s = shingle_set(text.as_py())
                if len(s) and (k := (_key(s), len(s))) not in known:
                    known.add(k)
                    fresh[k] = in_order(s, frequent, rank)[: _prefix(len(s))]
            if fresh:
                each = [len(v) for v in fresh.values()]
                yield pa.record_batch({
                    "_h": np.concatenate(list(fresh.values())),
                    "_key": np.repeat(np.array([k for k, _ in fresh], np.int64), each),
                    "_n": np.repeat(np.array([n for _, n in fresh], np.int32), each),
                    "_pos": np.concatenate([np.arange(c, dtype=np.int32) for c in each]),
                })

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by shingle and set, those whose shingle has another set; repeated ones once."""
    held: pa.RecordBatch | None = None
    open_list = False
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        h, key, n = (batch.column(c).to_numpy() for c in (0, 1, 2))
        same = h[1:] == h[:-1]
        twin = same & (key[1:] == key[:-1]) & (n[1:] == n[:-1])
        other = same & ~twin
        # A list is shared if any two neighbours in it differ; its bounds are where the shingle changes.
        start = np.concatenate([[0], np.flatnonzero(~same) + 1])
        has = np.add.reduceat(np.concatenate([other, [False]]).astype(np.int64), start) > 0
        if held is not None and open_list:
            has[0] = True
        sizes = np.diff(np.concatenate([start, [len(h)]]))
        keep = np.repeat(has, sizes)
        keep[1:] &= ~twin
        if held is not None and open_list:
            keep[0] = False  # given out before
        # The last list may go on: its last entry is held, the others go out when it is shared.
        last = start[-1]
        open_list = bool(has[-1])
        if not open_list:
            held = batch.slice(last, 1)
        else:
            held = batch.slice(len(h) - 1, 1)
        if keep.any():
            yield batch.filter(pa.array(keep))


def _linked(x: np.ndarray, y: np.ndarray, shared: int) -> bool:
    return 100 * shared >= 75 * (len(x) + len(y) - shared)


def _meet(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _block(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """A block's sets, what of the first one (the pivot) each lacks, and what each has beyond it."""
    sets = [shingle_set(t) for t in texts]
    less = [np.setdiff1d(sets[0], s, assume_unique=True) for s in sets]
    return sets, less, [np.setdiff1d(s, sets[0], assume_unique=True) for s in sets]


def _answers(block: tuple, y: np.ndarray) -> bool:
    """Whether any set of a block links to ``y``, with the pivot's answer for its members."""
    sets, less, more = block
    base = None
    for x, lo, hi in zip(sets, less, more, strict=True):
        if 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
            base = _meet(sets[0], y) if base is None else base
            if _linked(x, y, base - _meet(lo, y) + _meet(hi, y)):
                return True
    return False


#: Rows of what meets: the group, the side (0 before 1), what a link of side 1 leads to, and the document.
_GROUP = ["_u", "_ub", "_g", "_gb"]
_WANTED = "_u long, _ub long, _g long, _gb long, _side int, _v long, _id long"
_ROW = [*_GROUP, "_side", "_v", "_id"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple, list]]:
    """(group, (side, v, id), other columns as Arrow scalars) of sorted rows."""
    for batch in batches:
        meta = list(zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True))
        for n, row in enumerate(meta):
            yield row[:4], row[4:], [c[n] for c in batch.columns[7:]]


def _could(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (_ROW, size, indexed shingles, bitmap), sorted by group and side, those that may link to one of the other
    side: together, what they share of their indexed shingles and all shingles after those reach a link, and their bitmaps
    do not differ in more bits than a link allows."""
    out: list[tuple] = []
    held: tuple | None = None
    left: list[tuple] = []  # the rows of side 0: row, size, shingles, bitmap
    used: set[int] = set()
    index: tuple | None = None
    for group, (side, v, i), (size, hs, bits) in _groups(batches):
        if group != held:
            out += [left[k][0] for k in sorted(used)]
            held, left, used, index = group, [], set(), None
            if len(out) >= 10_000:
                yield pa.record_batch(list(map(pa.array, zip(*out, strict=True))), _ROW).cast(_SCHEMA)
                out = []
        hs, n, bits = hs.values.to_numpy(), size.as_py(), np.frombuffer(bits.as_py(), np.uint8)
        if side == 0:
            left.append(((*group, side, v, i), n, hs, bits))
            continue
        if not left:
            continue
        if index is None:
            every = np.concatenate([x[2] for x in left])
            owner = np.repeat(np.arange(len(left)), [len(x[2]) for x in left])
            order = np.argsort(every, kind="stable")
            index = every[order], owner[order], np.array([x[1] for x in left], np.int64)
        every, owner, sizes = index
        a, b = np.searchsorted(every, hs, "left"), np.searchsorted(every, hs, "right")
        at = np.concatenate([np.arange(x, y) for x, y in zip(a[b > a], b[b > a], strict=True)]) if (b > a).any() else np.zeros(0, np.int64)
        shared = np.bincount(owner[at], minlength=len(left))
        after = np.maximum((3 * sizes + 3) // 4, (3 * n + 3) // 4) - 1
        fine = (7 * (shared + after) >= 3 * (sizes + n)) & (4 * np.minimum(sizes, n) >= 3 * np.maximum(sizes, n)) & (shared > 0)
        fine = [k for k in np.flatnonzero(fine).tolist() if 7 * (differences(left[k][3], bits) + differences(bits, left[k][3])) <= left[k][1] + n]
        if fine:
            used |= set(fine)
            out.append((*group, side, v, i))
    out += [left[k][0] for k in sorted(used)]
    if out:
        yield pa.record_batch(list(map(pa.array, zip(*out, strict=True))), _ROW).cast(_SCHEMA)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, b, rows, largest size, bits of any member, bits of all members, null if they are the same) of rows (c, b, size,
    bitmap) sorted by block."""
    held: tuple | None = None
    count, most, some, every = 0, 0, None, None

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array([x], pa.int64()) for x in (*held, count, most)] + [pa.array([x], pa.binary()) for x in (some.tobytes(), None if (some == every).all() else every.tobytes())], ["c", "b", "count", "most", "some", "every"])

    for batch in batches:
        for c, b, n, bits in zip(*(x.to_pylist() for x in batch.columns[:3]), batch.column(3), strict=True):
            bits = np.frombuffer(bits.as_py(), np.uint8)
            if (c, b) != held:
                if held is not None:
                    yield out()
                held, count, most, some, every = (c, b), 1, n, bits, bits
                continue
            size = min(len(some), len(bits))
            count, most, some, every = count + 1, max(most, n), _fold(some, size) | _fold(bits, size), _fold(every, size) & _fold(bits, size)
    if held is not None:
        yield out()


def _blocks_could(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (_GROUP, rows, largest sizes, bits of any and all members of both sides), those whose blocks may hold a link:
    what all members have and no member of the other side is apart in every pair."""
    for batch in batches:
        keep = []
        for m, k, *maps in zip(*(batch.column(x).to_pylist() for x in range(6, 8)), *(batch.column(x) for x in range(8, 12)), strict=True):
            some, every, some_too, every_too = (np.frombuffer(x.as_py() if x.is_valid else like.as_py(), np.uint8) for x, like in zip(maps, (maps[0], maps[0], maps[2], maps[2]), strict=True))
            apart = sum(differences(a, b) for a, b in ((every, some_too), (every_too, some)))
            keep.append(7 * apart <= m + k)
        yield pa.record_batch(batch.columns[:6], [*_GROUP, "xcount", "ycount"]).filter(pa.array(keep, pa.bool_()))


_SCHEMA = pa.schema([(c, pa.int32() if c == "_side" else pa.int64()) for c in _ROW])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) from rows (_ROW, text) sorted by group and side. One block is held, and its texts, so that the next
    group with the same block does not read them again."""
    found: dict[tuple[int, int], None] = {}
    held: tuple | None = None
    texts: list[str] = []
    block: tuple | None = None
    known: tuple[list[str], tuple] | None = None
    last: tuple | None = None
    for group, (side, v, i), (text,) in _groups(batches):
        if group != held:
            held, texts, block, last = group, [], None, None
            if len(found) >= 10_000:
                yield _links(found)
                found = {}
        if side == 0:
            # Rows that repeat an id stand together: a text counts once.
            if (i, said := text.as_py()) != last:
                texts.append(said)
                last = i, said
            continue
        if not texts or (group[0], v) in found:
            continue
        if block is None:
            if known is None or known[0] != texts:
                known = texts, _block(texts)
            block = known[1]
        if _answers(block, shingle_set(text.as_py())):
            found[group[0], v] = None
    yield _links(found)


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_ROW, text) without those that a task met before, as far as it remembers them: an id that many rows repeat sends a
    text once a task."""
    seen: set[tuple] = set()
    for batch in batches:
        keep = []
        for row, text in zip(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True), batch.column(len(_ROW)), strict=True):
            row = *row, xxhash.xxh3_128_digest(text.as_buffer())
            keep.append(row not in seen)
            seen.add(row)
        if len(seen) > KNOWN:
            seen.clear()
        yield batch.filter(pa.array(keep, pa.bool_()))


def _links(found: dict[tuple[int, int], None]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], ["u", "v"])


def _can_share(a: str, b: str):
    """Columns: sizes and positions of two entries of a list allow a link."""
    need = F.ceil((F.col(f"{a}n") + F.col(f"{b}n")) * 3 / F.lit(7.0))
    left = F.least(F.col(f"{a}n") - F.col(f"{a}pos"), F.col(f"{b}n") - F.col(f"{b}pos"))
    return (left >= need) & (F.least(f"{a}n", f"{b}n") * 4 >= F.greatest(f"{a}n", f"{b}n") * 3)


def _bits_of(ids: DataFrame, read: DataFrame, scratch: Scratch) -> DataFrame:
    """(_y, _k, _bits): the bitmaps of some documents' sets, once each."""
    ids = scratch.written(ids.distinct().withColumnRenamed("_id", "_y"), "ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    found = read.select(F.col("_id").alias("_y"), F.col("_key").alias("_k"), "_bits").join(ids, "_y", "left_semi")
    return found.groupBy("_y", "_k").agg(F.first("_bits").alias("_bits"))


def _linking(wanted: DataFrame, indexed: DataFrame, read: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (u, v) of what meets. Indexed shingles and bitmaps, a tenth of the texts, meet first; then the texts of what
    may link. Up to a checked number of rows, what is wanted is sent to the scan of the texts."""
    met = lambda df: df.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "_side", "_id")
    arrays = indexed.select(F.col("_s").alias("_x"), "_key", "_n", F.transform("_e", lambda e: e["_h"]).alias("_hs"))
    bits = _bits_of(wanted.select("_id"), read, scratch)
    arrays = wanted.join(arrays, F.col("_id") == F.col("_x")).join(bits, (F.col("_id") == F.col("_y")) & (F.col("_key") == F.col("_k")))
    reach = met(arrays.select(*_ROW, "_n", "_hs", "_bits")).mapInArrow(_could, _WANTED)
    reach = scratch.written(reach.distinct(), "reaching")
    small = reach.count() <= BROADCAST_ROWS
    texts = docs.filter("_text is not null").withColumnRenamed("_id", "_x").join(F.broadcast(reach) if small else reach, F.col("_x") == F.col("_id"))
    with small_batches(docs.sparkSession):
        texts = texts.select(*_ROW, "_text").mapInArrow(_fresh, f"{_WANTED}, _text string")
        return scratch.written(met(texts).mapInArrow(_verify, "u long, v long"), "links")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, n_equal) for each row of ``df``.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A set holds a text's distinct 5-word
    shingles, or its whole word sequence as one if there are fewer words; a null text or one without
    words has an empty set, links with nothing and is its own component. ``component_id`` is the smallest
    id reachable by links of Jaccard similarity 0.75 or more, ``n_equal`` the rows with the same set.
    Ids are integers; a row without one takes no part and has a null component. Rows that repeat an id
    are one document with several texts, linked by any of them. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    with small_batches(docs.sparkSession):
        read = scratch.written(docs.mapInArrow(_signatures, "_id long, _n long, _key long, _bits binary, _often array<struct<h:long,c:long>>"), "signatures")
    signs = written(read.select("_id", "_n", "_key"), "sizes")
    sets = written(signs.filter("_n > 0").groupBy("_key", "_n").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_equal")), "sets")

    often = read.select(F.explode("_often").alias("o")).groupBy(F.col("o.h").alias("_h")).agg(F.sum("o.c").alias("_c")).filter("_c >= 16")
    top = often.orderBy(F.desc("_c"), "_h").limit(FREQUENT).toPandas()
    by_hash = np.argsort(top["_h"].to_numpy(np.int64))
    frequent, rank = top["_h"].to_numpy(np.int64)[by_hash], (len(top) - by_hash).astype(np.int64)

    # For each set, the entries of the lists that it shares with another one, in order.
    entries = docs.select("_text").mapInArrow(_index(frequent, rank), "_h long, _key long, _n int, _pos int")
    shared = entries.repartition("_h").sortWithinPartitions("_h", "_key", "_n").mapInArrow(_shared, "_h long, _key long, _n int, _pos int")
    indexed = shared.groupBy("_key", "_n").agg(F.array_sort(F.collect_list(F.struct("_pos", "_h"))).alias("_e"))
    named = sets.filter("_rep is not null").select(F.col("_key").alias("_k"), F.col("_n").alias("_m"), "_rep")
    with small_batches(docs.sparkSession):
        indexed = scratch.written(indexed.join(named, (F.col("_m") == F.col("_n")) & (F.col("_key") == F.col("_k"))).select(F.col("_rep").alias("_s"), "_key", "_n", "_e"), "indexed")

    # Every set meets the leading sets of its first lists. A leading set's members are dealt in groups.
    listed = lambda e: indexed.select("_s", "_n", F.explode(e).alias("e")).select("_s", "_n", "e._h", "e._pos")
    leading = listed(F.col("_e")).groupBy("_h").agg(F.min(F.struct(F.xxhash64("_s", "_h").alias("r"), F.col("_s").alias("s"), F.col("_n").alias("n"), F.col("_pos").alias("pos"))).alias("l"))
    leading = leading.select(F.col("_h").alias("_lh"), F.col("l.s").alias("l_s"), F.col("l.n").alias("l_n"), F.col("l.pos").alias("l_pos"))
    near = listed(F.slice("_e", 1, LEADERS)).join(leading, F.col("_h") == F.col("_lh")).filter("_s <> l_s").filter(_can_share("_", "l_"))
    pairs = near.groupBy(F.least("_s", "l_s").alias("u"), F.greatest("_s", "l_s").alias("v")).agg(F.min("l_s").alias("lead"))
    pairs = scratch.written(pairs.select("lead", F.when(F.col("lead") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("member")), "pairs")
    groups = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / F.lit(MEMBERS)).alias("_k")).withColumnRenamed("lead", "_l")
    stars = pairs.join(groups, F.col("lead") == F.col("_l")).select("lead", "member", F.pmod(F.xxhash64("member"), "_k").alias("part"))
    star = lambda df, side, v: df.select(F.col("lead").alias("_u"), F.col("part").alias("_ub"), F.lit(0).cast("long").alias("_g"), F.lit(0).cast("long").alias("_gb"), F.lit(side).alias("_side"), F.col(v).alias("_v"), F.col(v).alias("_id"))
    wanted = star(stars, 1, "member").unionByName(star(stars.select("lead", "part").distinct(), 0, "lead"))
    edges = _linking(scratch.written(wanted, "wanted"), indexed, read, docs, scratch)

    # Components so far, in blocks; then only blocks of different components meet.
    part = scratch.written(components(edges), "components")
    size = part.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(MEMBERS)).alias("_blocks")).withColumnRenamed("component", "_c")
    placed = part.join(size, F.col("component") == F.col("_c")).select("node", "component", F.pmod(F.xxhash64("node"), "_blocks").alias("block"))
    blocks = indexed.join(placed, F.col("_s") == F.col("node"), "left")
    blocks = scratch.written(blocks.select("_s", "_key", "_n", "_e", F.coalesce("component", "_s").alias("c"), F.coalesce("block", F.lit(0)).cast("long").alias("b")), "blocks")
    # A block's members are in one task, so a list shrinks to its blocks there, before it is dealt by shingle.
    held = blocks.repartition("c", "b").select("c", "b", "_n", F.explode("_e").alias("e")).groupBy(F.col("e._h").alias("_h"), "c", "b")
    held = held.agg(F.min("_n").alias("least"), F.max("_n").alias("most"), F.max(F.col("_n") - F.col("e._pos")).alias("left")).repartition("_h")
    every = Window.partitionBy("_h")
    held = held.withColumn("_lo", F.min("c").over(every)).withColumn("_hi", F.max("c").over(every)).filter("_lo <> _hi").drop("_lo", "_hi")
    x, y = (held.select(F.col("_h").alias(f"{k}h"), *[F.col(c).alias(f"{k}{c}") for c in ("c", "b", "least", "most", "left")]) for k in "xy")
    may = (F.col("xc") < F.col("yc")) & (F.col("xmost") * 4 >= F.col("yleast") * 3) & (F.col("ymost") * 4 >= F.col("xleast") * 3)
    reach = F.least("xleft", "yleft") * 7 >= (F.col("xleast") + F.col("yleast")) * 3  # holds in the first list that a linking pair shares
    met = scratch.written(x.join(y, (F.col("xh") == F.col("yh")) & may & reach).select(F.col("xc").alias("_u"), F.col("xb").alias("_ub"), F.col("yc").alias("_g"), F.col("yb").alias("_gb")).distinct(), "meetings")
    # First by a summary of each block, then by its members.
    pair = lambda c, b: F.struct(F.col(c).alias("kc"), F.col(b).alias("kb"))
    named_blocks = met.select(F.explode(F.array(pair("_u", "_ub"), pair("_g", "_gb"))).alias("k")).select("k.*").distinct()
    members = scratch.written(blocks.select("c", "b", "_s", "_key", "_n").join(named_blocks, (F.col("kc") == F.col("c")) & (F.col("kb") == F.col("b")), "left_semi"), "members")
    bits = _bits_of(members.select(F.col("_s").alias("_id")), read, scratch)
    dealt = members.join(bits, (F.col("_s") == F.col("_y")) & (F.col("_key") == F.col("_k"))).select("c", "b", "_n", "_bits").repartition("c", "b").sortWithinPartitions("c", "b")
    known = scratch.written(dealt.mapInArrow(_summaries, "c long, b long, count long, most long, some binary, every binary"), "summaries")
    x, y = (known.select(*[F.col(c).alias(f"{k}{c}") for c in known.columns]) for k in "xy")
    met = met.join(x, (F.col("_u") == F.col("xc")) & (F.col("_ub") == F.col("xb"))).join(y, (F.col("_g") == F.col("yc")) & (F.col("_gb") == F.col("yb")))
    met = met.select(*_GROUP, "xcount", "ycount", "xmost", "ymost", "xsome", "xevery", "ysome", "yevery").mapInArrow(_blocks_could, ", ".join(f"{c} long" for c in (*_GROUP, "xcount", "ycount")))
    # The larger block of two stays in its place, and the members of all smaller ones that meet it pass by: so members of a
    # block are copied once for WAITING of those, not for each.
    turned = F.col("xcount") < F.col("ycount")
    side = lambda a, b, name: F.when(turned, F.col(b)).otherwise(F.col(a)).alias(name)
    met = scratch.written(met.select(side("_u", "_g", "hc"), side("_ub", "_gb", "hb"), side("_g", "_u", "oc"), side("_gb", "_ub", "ob"), F.least("xcount", "ycount").alias("n")), "meetings")
    salts = met.groupBy("hc", "hb").agg(F.ceil(F.sum("n") / F.lit(WAITING)).alias("_salts")).select(F.col("hc").alias("_c"), F.col("hb").alias("_b"), "_salts")
    met = met.join(salts, (F.col("hc") == F.col("_c")) & (F.col("hb") == F.col("_b"))).withColumn("salt", F.pmod(F.xxhash64("oc", "ob"), "_salts"))
    ids = members.select("c", "b", "_s").distinct()
    to_rows = lambda df, number, v: df.select(F.col("hc").alias("_u"), F.col("hb").alias("_ub"), F.col("salt").alias("_g"), F.lit(0).cast("long").alias("_gb"), F.lit(number).alias("_side"), F.col(v).alias("_v"), F.col("_s").alias("_id"))
    held = to_rows(met.select("hc", "hb", "salt").distinct().join(ids, (F.col("hc") == F.col("c")) & (F.col("hb") == F.col("b"))), 0, "hc")
    passing = to_rows(met.join(ids, (F.col("oc") == F.col("c")) & (F.col("ob") == F.col("b"))), 1, "oc")
    more = _linking(scratch.written(held.unionByName(passing), "wanted"), indexed, read, docs, scratch)
    final = written(components(part.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)), "components")
    scratch.clear()

    named = sets.join(final, F.col("_rep") == F.col("node"), "left").select(F.col("_key").alias("_k"), F.col("_n").alias("_m"), F.coalesce("component", "_rep").alias("component_id"), F.col("_equal").alias("n_equal"))
    out = signs.join(named, (F.col("_key") == F.col("_k")) & (F.col("_n") == F.col("_m")), "left")
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id")).alias("component_id"), F.coalesce("n_equal", F.lit(1)).alias("n_equal"))
