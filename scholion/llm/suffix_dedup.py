"""Removal of repeated passages by suffix order, from merged Burrows-Wheeler transforms.

A byte goes when it is covered by a string of ``length`` bytes that also starts earlier, in a smaller
document or earlier in the same one. To find these strings over any number of machines:

1. *Cut by content.* Of the 40-byte grams in every window of ``length`` bytes, the one with the smallest hash
   is the window's anchor. The choice depends on the window's bytes alone, so equal windows have equal
   anchors, and a run of windows with one anchor is one record. Records are dealt by anchor; an anchor
   that occurs once needs no further look.
2. *Whole records.* Records with equal bytes repeat from the second on. Of the records of a slice that are equal
   only the first is sent, so that a passage in a third of all documents meets itself once a slice.
3. *Suffixes.* Records that share an anchor but not all bytes are gathered, as bytes, in collections of bounded size.
   A collection is cut into shards; every shard is sorted by suffix and gives its Burrows-Wheeler transform.
   The transforms are merged by refining their interleave: stably sorting it by the merged transform's
   symbols (two at a time) orders it by as many more leading symbols, and where neighbours of a bucket come from
   different blocks, a block begins. A block that holds rotations of one shard only is settled: their order and
   which of them are equal is known from that shard, so the refinement goes on with the blocks in which shards
   still meet. No suffix is compared or sorted again. After ``length`` symbols, blocks are the intervals of equal
   windows, and all but the earliest window of a block repeat.
4. Records of an anchor that has more than ``HOT`` different ones are cut by further context first: windows whose
   anchor stands at one of ``PLACES`` neighbouring places share all but a few bytes, and are dealt by a hash of those.
   What is still hot then is cut into single windows, whose class is one interval of equal windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholion.llm.common import Scratch, slices, small_batches, written

LENGTH, GRAM = 100, 40
#: Different records of an anchor, neighbouring places of an anchor, bytes of a collection and of a shard.
HOT, PLACES, COLLECTION, SHARD = 2000, 8, 1 << 20, 256 << 10
#: Tasks that merge collections: one for so many bytes, but no more than that.
TASK_BYTES, TASKS = 4 << 20, 20_000
#: Spans of documents that are sent to every task, as counted entries (16 bytes each).
BROADCAST_SPANS = 2_000_000
#: A byte that UTF-8 never has.
SEPARATOR = 0xFF
_STEP = 1 << 17
_LOW = np.uint64((1 << 18) - 1)
_BASE = 0xD1B54A32D192ED03
_BYTE = np.random.default_rng(20240602).integers(0, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int) -> np.ndarray:
    out = np.full(_STEP + 2 * LENGTH + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def records(text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor's hash, digest, first window, anchor's place in it, windows after it) of a text's records, by
    blocks: a run that a block's end cuts is two records."""
    grams = LENGTH - GRAM + 1
    for start in range(0, len(text) - LENGTH + 1, _STEP):
        b = np.frombuffer(text, np.uint8, min(_STEP + LENGTH - 1, len(text) - start), start)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[b] * _UP[: len(b)], dtype=np.uint64)])
        h = _mix((sums[GRAM:] - sums[:-GRAM]) * _DOWN[: len(b) - GRAM + 1])
        least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)  # ties to the left
        width = 1
        while 2 * width <= grams:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < grams:
            least = np.minimum(least[: len(least) - (grams - width)], least[grams - width :])
        at = (least & _LOW).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        last = np.concatenate([first[1:], [len(at)]]) - 1
        place, more = at[first] - first, last - first
        body = (sums[last + LENGTH] - sums[first]) * _DOWN[first]
        digest = _mix(body + _mix((place * 1024 + more).astype(np.uint64)))
        yield h[at[first]].view(np.int64), digest.view(np.int64), first + start, place, more


_ROW = "_f long, _g long, _id long, _n int, _s int, _e int, _kind int"
_NAMES = ["_f", "_g", "_id", "_n", "_s", "_e", "_kind"]
#: Kinds of rows: a record, a repeated one, one to compare.
RECORD, REPEATED, COMPARE = 0, 1, 2


def _batch(f, g, i, n, s, e, kind) -> pa.RecordBatch:
    return pa.record_batch([f, g, i, *(c.astype(np.int32) for c in (n, s, e, kind))], _NAMES)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of rows (_id, _n, _text)."""
    for batch in (part for batch in batches for part in slices(batch, 2, 6 << 20)):
        cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for i, n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            for f, g, s, _, e in records((t.as_py() or "").encode()):
                for c, v in zip(cols, (f, g, np.full(len(f), i), np.full(len(f), n), s, e), strict=True):
                    c.append(v)
        if not cols[0]:
            continue
        f, g, i, n, s, e = map(np.concatenate, cols)
        order = np.lexsort((s, n, i, g, f))
        f, g, i, n, s, e = (c[order] for c in (f, g, i, n, s, e))
        fresh = np.concatenate([[True], (f[1:] != f[:-1]) | (g[1:] != g[:-1])])
        head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        repeated = (i != i[head]) | (n != n[head]) | (s != s[head])
        keep = fresh | repeated  # what is left out is a row of the same id and text
        yield _batch(*(c[keep] for c in (f, g, i, n, s, e, repeated)))


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor, digest, document and start: those that repeat a whole record, and the first
    of each record whose anchor has another record."""
    held: np.ndarray | None = None  # the first row of the record that may go on
    given = several = False  # whether that row went out, and whether its anchor has two records
    for batch in batches:
        rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])
        done = rows[:, rows[6] == REPEATED]
        if done.shape[1]:
            yield _batch(*done)
        rows = rows[:, rows[6] == RECORD]
        if not rows.shape[1]:
            continue
        if held is not None:
            rows = np.concatenate([held[:, None], rows], 1)
        f, g, i, n, s = rows[:5]
        new_f = np.concatenate([[True], f[1:] != f[:-1]])
        new_g = new_f | np.concatenate([[True], g[1:] != g[:-1]])
        heads = np.flatnonzero(new_g)
        head = heads[np.cumsum(new_g) - 1]
        repeated = (i != i[head]) | (n != n[head]) | (s != s[head])
        group = np.cumsum(new_f) - 1
        count = np.bincount(group[heads])
        if held is not None and several:
            count[0] += 1
        compare = new_g & (count[group] > 1)
        if held is not None and given:
            compare[0] = False
        out = np.where(repeated, REPEATED, COMPARE)
        keep = repeated | compare
        if keep.any():
            yield _batch(*rows[:6, keep], out[keep])
        was_given = given and held is not None and heads[-1] == 0
        held, several = rows[:, heads[-1]].copy(), bool(count[-1] > 1)
        given = several or was_given


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotations of ``text`` (bytes) in the order of their first ``depth`` (8 or more) symbols, and which of them differ
    in these from the one before. Eight symbols are one number; from there a rotation is ordered by its own rank and the
    rank of what follows, for as long as it shares its rank."""
    n = len(text)
    first = np.zeros(n, np.uint64)
    for k in range(8):
        first = (first << np.uint64(8)) | np.roll(text, -k)
    order = np.argsort(first)
    first = first[order]
    edge = np.concatenate([[True], first[1:] != first[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(edge)[np.cumsum(edge) - 1]
    done = 8
    while done < depth:
        alone = edge & np.concatenate([edge[1:], [True]])
        shared = np.flatnonzero(~alone)
        if not len(shared):
            break
        step = min(done, depth - done)
        at = order[shared]
        key = rank[at] * n + rank[(at + step) % n]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[shared] = at
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        edge[shared] = fresh
        rank[at] = shared[fresh][np.cumsum(fresh) - 1]
        done += step
    return order, edge


def merged_classes(shards: list[np.ndarray], depth: int) -> np.ndarray:
    """For every rotation of every shard, in the order of the concatenated texts, a number that rotations with the
    same first ``depth`` (even) symbols share, from the shards' transforms, by refining their interleave."""
    starts = np.cumsum([0, *map(len, shards)])
    where = np.repeat(np.arange(len(shards), dtype=np.int16), [len(t) for t in shards])
    place = np.empty(starts[-1], np.int64)  # of every row of a shard's order, its place in the concatenated texts
    label = np.empty(starts[-1], np.int64)  # of every row, the first row that its shard knows to be equal
    transform, back = np.empty(starts[-1], np.uint16), np.empty(starts[-1], np.int64)  # the two symbols before a row, and the row that starts with them
    for text, start in zip(shards, starts, strict=False):
        order, edge = suffix_order(text, depth)
        own = slice(start, start + len(text))
        place[own] = start + order
        label[own] = start + np.flatnonzero(edge)[np.cumsum(edge) - 1]
        row = np.empty(len(text), np.int64)
        row[order] = np.arange(start, start + len(text))
        pairs = (np.roll(text, 2).astype(np.uint16) << np.uint16(8)) | np.roll(text, 1)
        transform[own], back[own] = pairs[order], row[order - 2]
    rows, block = np.arange(starts[-1]), np.zeros(starts[-1], np.int64)
    for _ in range(depth // 2 if len(shards) > 1 else 0):
        symbol = transform[rows]
        by = np.argsort(symbol, kind="stable")
        rows, before, symbol = back[rows[by]], block[by], symbol[by]
        first = np.flatnonzero(np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (before[1:] != before[:-1])]))
        sizes, shard = np.diff(np.append(first, len(rows))), where[rows]
        meet = np.minimum.reduceat(shard, first) != np.maximum.reduceat(shard, first)
        rows, block = rows[np.repeat(meet, sizes)], np.repeat(np.arange(np.count_nonzero(meet)), sizes[meet])
        if not len(rows):
            break
    if len(shards) > 1 and len(rows):  # intervals in which shards meet: one number for the numbers of the shards
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        label[rows] = np.minimum.reduceat(label[rows], first)[block]
    out = np.empty(len(place), np.int64)
    out[place] = label
    return out


def repeated_windows(items: list[tuple[tuple[int, int], int, int, bytes]], length: int = LENGTH, shard: int = SHARD) -> np.ndarray:
    """Rows (document, ordinal, start) of the windows that also start earlier, of items ((document, ordinal), start,
    windows after the first, bytes)."""
    # Documents are dealt to shards, so that what documents have in common meets where transforms are merged.
    count = -(-sum(len(b) + 1 for *_, b in items) // shard)
    dealt = [hash(key) % count for key, *_ in items]
    shards, at = [[] for _ in range(count)], []
    for n in sorted(range(len(items)), key=dealt.__getitem__):
        key, s, e, b = items[n]
        shards[dealt[n]].append(b)
        at.append((*key, s, e, len(b) + 1))
    shards = [parts for parts in shards if parts]
    joined = [np.frombuffer(bytes([SEPARATOR]).join([*parts, b""]), np.uint8) for parts in shards]
    label = merged_classes(joined, length)
    doc, ordinal, s, e, sizes = np.array(at, np.int64).T
    starts = np.cumsum(sizes) - sizes
    item = np.repeat(np.arange(len(at)), e + 1)
    offset = np.arange(len(item)) - np.repeat(np.cumsum(e + 1) - e - 1, e + 1)
    rows = np.stack([label[starts[item] + offset], doc[item], ordinal[item], s[item] + offset])
    rows = rows[:, np.lexsort(rows[::-1])]
    fresh = np.concatenate([[True], rows[0, 1:] != rows[0, :-1]])
    head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    return rows[1:, (rows[1:] != rows[1:, head]).any(0)]


_MARK = "_id long, _n int, _from int, _to int"


def _collections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks from rows (_f, _id, _n, _s, _e, _bytes) sorted by anchor: whole anchors up to a collection's size together.
    Windows that follow each other are one mark."""

    def marks(items: list[tuple[tuple[int, int], int, int, bytes]]) -> pa.RecordBatch:
        rows = repeated_windows(items)
        rows = rows[:, np.lexsort(rows[::-1])]
        doc, ordinal, s = rows
        fresh = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (ordinal[1:] != ordinal[:-1]) | (s[1:] > s[:-1] + 1)])[: len(doc)])
        last = np.append(fresh[1:], len(doc))[: len(fresh)] - 1
        return pa.record_batch({"_id": doc[fresh], "_n": ordinal[fresh].astype(np.int32), "_from": s[fresh].astype(np.int32), "_to": (s[last] + LENGTH).astype(np.int32)})

    items: list[tuple[tuple[int, int], int, int, bytes]] = []
    size, last = 0, None
    for batch in batches:
        for f, i, n, s, e, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if f != last and size >= COLLECTION:
                yield marks(items)
                items, size = [], 0
            items.append(((i, n), s, e, b))
            size, last = size + len(b), f
    if items:
        yield marks(items)


_PIECE = "_f long, _id long, _n int, _s int, _e int, _bytes binary"
_PIECES = ["_f", "_id", "_n", "_s", "_e", "_bytes"]


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * 6
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _PIECES)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of records, from (_id, _n, _text, _want). Rows that repeat an id and its text give them once where they
    meet, which saves work and decides nothing."""
    last = None
    for batch in (part for batch in batches for part in slices(batch, 2)):
        out = []
        for i, n, t, want in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (i, n) == last:
                continue
            last, b = (i, n), (t or "").encode()
            out += [(w["f"], i, n, w["s"], w["e"], b[w["s"] : w["s"] + w["e"] + LENGTH]) for w in want]
        yield _piece_batch(out)


def pieces(i: int, n: int, s: int, e: int, b: bytes) -> Iterator[tuple]:
    """A record cut by its anchor's place: ``PLACES`` places together, keyed by the bytes that their windows share."""
    (_, _, _, place, _) = next(records(b))
    anchor = int(place[0])
    for group in range((anchor - e) // PLACES, anchor // PLACES + 1):
        lo, hi = max(0, anchor - group * PLACES - PLACES + 1), min(e, anchor - group * PLACES)
        shared = b[anchor - group * PLACES : anchor - group * PLACES - PLACES + 1 + LENGTH]
        key = hashlib.blake2b(shared, digest_size=8, salt=bytes([group])).digest()
        yield int.from_bytes(key, "big", signed=True), i, n, s + lo, hi - lo, b[lo : hi + LENGTH]


def _further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for batch in batches for part in slices(batch, 5, 1 << 20)):
        yield _piece_batch([p for _, i, n, s, e, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) for p in pieces(i, n, s, e, b)])


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and touching marks of a document as maximal runs."""
    for batch in batches:
        starts, ends, sizes = [], [], [0]
        for marks in batch.column(2):
            a, b = (marks.values.field(k).to_numpy() for k in range(2))
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            first = np.concatenate([[0], np.flatnonzero(a[1:] > b[:-1]) + 1])
            starts.append(a[first])
            ends.append(b[np.append(first[1:], len(b)) - 1])
            sizes.append(len(first))
        runs = pa.StructArray.from_arrays([np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64) for c in (starts, ends)], ["start", "end"])
        yield pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), runs)], ["_mid", "_mn", "_spans"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for batch in batches for part in slices(batch, 1)):
        sizes, kept = [], []
        for t, spans in zip(batch.column(1), batch.column(2), strict=True):
            b, at, out = (t.as_py() or "").encode(), 0, []
            for s in spans.as_py() or ():
                out.append(b[at : s["start"]])
                at = s["end"]
            sizes.append(len(b))
            kept.append(b"".join([*out, b[at:]]))
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), batch.column(2), pa.array(kept, pa.binary())], ["_id", "n_bytes", "spans", "kept"])


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with ``_n``, which tells different texts of one id apart: 0 but for ids with several."""
    texts = docs.select("_id", F.xxhash64(F.coalesce("_text", F.lit(""))).alias("_x"))
    several = texts.groupBy("_id").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).filter("_id is not null and _lo <> _hi")
    several = scratch.written(several.select("_id"), "several")
    if several.isEmpty():
        return docs.withColumn("_n", F.lit(0))
    found = texts.join(several, "_id", "left_semi").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("_id").orderBy("_x")))
    found = written(found.select(F.col("_id").alias("_i"), F.col("_x").alias("_y"), "_n"), "ordinals")
    keyed = docs.withColumn("_x", F.xxhash64(F.coalesce("_text", F.lit(""))))
    return keyed.join(found, (F.col("_id") == F.col("_i")) & (F.col("_x") == F.col("_y")), "left").select("_id", "_text", F.coalesce("_n", F.lit(0)).alias("_n"))


def _firsts(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of pieces that are equal the first one, and marks of the others. The two sides of the join are dealt anew, by hash
    too, so that Spark can split the partition of a piece that a large part of all documents share."""
    place = F.struct("_id", "_n", "_s")
    first = rows.groupBy("_f", "_bytes").agg(F.min(place).alias("_first"), F.min("_e").alias("_e"))
    first = scratch.written(first.select("_f", "_first._id", "_first._n", "_first._s", "_e", "_bytes"), "firsts")
    known = first.select(F.col("_f").alias("_kf"), F.col("_bytes").alias("_kb"), F.xxhash64("_bytes").alias("_kx"), F.struct("_id", "_n", "_s").alias("_first"))
    again = rows.join(known, (F.col("_f") == F.col("_kf")) & (F.xxhash64("_bytes") == F.col("_kx")) & (F.col("_bytes") == F.col("_kb"))).filter(place != F.col("_first"))
    return first, again.select("_id", "_n", F.col("_s").alias("_from"), (F.col("_s") + F.col("_e") + LENGTH).alias("_to"))


def _hot(rows: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.written(rows.groupBy("_f").count().filter(F.col("count") > HOT).select(F.col("_f").alias("_hf")), "hot")


def _by_context(cut: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """Records that no key has more than ``HOT`` of, for collections, and the marks found on the way there."""
    of = F.col("_f") == F.col("_hf")
    hot = _hot(cut, scratch)
    if hot.isEmpty():
        return cut, []
    first, again = _firsts(scratch.written(cut.join(hot, of, "left_semi").mapInArrow(_further, _PIECE), "pieces"), scratch)
    still = _hot(first, scratch)
    rest, marks = cut.join(hot, of, "left_anti"), [again]
    if still.isEmpty():
        return rest.unionByName(first), marks
    single = first.join(still, of, "left_semi").withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_e"))))
    single = single.select("_f", "_id", "_n", (F.col("_s") + F.col("_o")).alias("_s"), F.lit(0).alias("_e"), F.expr(f"substring(_bytes, _o + 1, {LENGTH})").alias("_bytes"))
    marks.append(_firsts(scratch.written(single, "windows"), scratch)[1])
    return rest.unionByName(first.join(still, of, "left_anti")), marks


def _merged(rows: DataFrame) -> DataFrame:
    """Marks of the records' repeated windows. Work follows the bytes, so tasks are dealt by them."""
    size = rows.agg(F.sum(F.col("_e") + LENGTH)).first()[0] or 0
    return rows.repartition(max(1, min(TASKS, -(-size // TASK_BYTES))), "_f").sortWithinPartitions("_f").mapInArrow(_collections, _MARK)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept) for each row of ``df``: the bytes of the text in UTF-8
    without those covered by a 100-byte string that also starts earlier. ``spans`` are the maximal removed runs
    [start, end), ``kept`` the remaining bytes; a cut may fall inside a character.

    A null text counts as empty. Ids are integers and order the documents. Rows that repeat an id and its text
    are one document, and each of them is returned with its removals; different texts of an id are documents of their
    own, in the order of a hash of the text. A row with a null id takes no part and keeps all its bytes. Texts under 100
    bytes lose nothing. Equality rests on bytes inside collections and on two 64-bit digests (of the anchor and of the
    whole record) for records that repeat whole. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession)
    docs = _numbered(df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")), scratch)
    known = docs.filter("_id is not null").select("_id", "_n", "_text")
    # Rows that are settled already pass through, and are dealt by themselves.
    deal = F.when(F.col("_kind") == REPEATED, F.xxhash64("_id", "_s")).otherwise(F.col("_f"))
    sorted_rows = known.mapInArrow(_records, _ROW).repartition(deal).sortWithinPartitions("_f", "_g", "_id", "_n", "_s")
    with small_batches(df.sparkSession):
        decided = scratch.written(sorted_rows.mapInArrow(_decide, _ROW), "decided")
    parts = decided.filter(F.col("_kind") == REPEATED).select("_id", "_n", F.col("_s").alias("_from"), (F.col("_s") + F.col("_e") + LENGTH).alias("_to"))

    # Texts and the places of their records to compare are dealt by document, at any size.
    want = decided.filter(F.col("_kind") == COMPARE).groupBy(F.col("_id").alias("_wid"), F.col("_n").alias("_wn")).agg(F.collect_list(F.struct(F.col("_f").alias("f"), F.col("_s").alias("s"), F.col("_e").alias("e"))).alias("_want"))
    cut = known.join(want.hint("merge"), (F.col("_id") == F.col("_wid")) & (F.col("_n") == F.col("_wn")))
    with small_batches(df.sparkSession):
        cut = scratch.written(cut.select("_id", "_n", "_text", "_want").mapInArrow(_cut, _PIECE), "segments")
    plain, more = _by_context(cut, scratch)
    parts = parts.unionByName(_merged(plain))
    for marks in more:
        parts = parts.unionByName(marks)
    spans = written(parts.groupBy(F.col("_id").alias("_mid"), F.col("_n").alias("_mn")).agg(F.collect_list(F.struct("_from", "_to")).alias("_marks")).mapInArrow(_spans, "_mid long, _mn int, _spans array<struct<start:long,end:long>>"), "spans")
    scratch.clear()
    size = spans.agg(F.count(F.lit(1)) + F.sum(F.size("_spans"))).first()[0] or 0
    spans = F.broadcast(spans) if size <= BROADCAST_SPANS else spans
    out = docs.join(spans, (F.col("_id") == F.col("_mid")) & (F.col("_n") == F.col("_mn")), "left").select("_id", "_text", "_spans").mapInArrow(_apply, "_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return out.select(
        F.col("_id").alias(id_col),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"),
        spans.alias("spans"),
        "kept",
    )
