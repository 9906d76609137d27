"""Collocations: phrases whose words stand together more often than their parts let expect.

Counts of all phrases of up to four words come from suffix trees that are cut at that depth and built in parts:

1. *Vertical partitioning.* Suffixes (a word and up to three after it, within a piece of text) have a key: 16 bits of a hash of
   each of their words, so that suffixes with a common prefix have keys with one. How many begin with
   each first word's bits, and with two and three words, is counted first, where texts are read, in arrays of fixed
   length. Prefixes are then packed in groups up to a budget; one over the budget is extended by a word, and what is
   over it with three words is dealt by the whole suffix. So a frequent word, or pair of words, is never one task's.
2. *Subtrees.* A block of text sends equal suffixes once, with their number, in order and without the words that the one
   before has in common. Tasks read them sorted by key, so a
   subtree's leaves come together, and build the tree of a bounded number of leaves at once: the totals of leaves are added up level by
   level, and a node that is final and too seldom takes its subtree along. Nodes that groups or parts share are sums to be added up.
3. Parts of a phrase and the phrases that hold it are found among the frequent nodes, by joins.

Keys only deal and sort: nodes are told apart by their words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.llm.common import Scratch, slices, small_batches, written

DEPTH, LEAST, SCALE, COVER, TOP = 4, 30, 2_000_000, 80, 2000
#: Counters of prefixes at each depth, and the suffixes of a group (more where there would be more than 16,384 groups).
COUNTERS, BUDGET, GROUPS = 1 << 16, 1 << 19, 1 << 14
#: Bytes of text of which equal suffixes are sent once, and leaves of which a tree is built at once.
STEP, LEAVES = 1 << 21, 1 << 18
#: Rankings of a language are first taken in so many parts.
SALTS = 64
#: A-Z become a-z, ends of pieces a line feed, a tab a space.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c for c in range(256))
_AHEAD = re.compile(rb"(?: *[^ \n]+){0,%d}" % (DEPTH - 1))
_ENDS = re.compile(rb"[ \n]")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _blocks(texts: list[bytes], step: int) -> Iterator[tuple[bytes, int]]:
    """(bytes, from where on no suffix begins) of texts, normalised: in blocks that end with a word and what suffixes
    in them need beyond."""
    plain = b"\n".join([*texts, b""]).translate(_PLAIN)
    start = 0
    while start < len(plain):
        end = _ENDS.search(plain, min(start + step, len(plain) - 1)).end() - 1  # the last byte ends a word
        ahead = _AHEAD.match(plain, end).end()
        yield plain[start:ahead] + b"\n", end - start
        start = end + 1


def suffixes(texts: list[bytes], step: int = STEP) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(different words; for every suffix the numbers of its words, -1 beyond its end; its key) by blocks."""
    for block, limit in _blocks(texts, step):
        b = np.frombuffer(block, np.uint8)
        apart = (b == 32) | (b == 10)
        edge = np.diff(np.concatenate([[True], apart]).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)  # a word and what ends it
        n = int(np.searchsorted(first, limit))
        if not n:
            continue
        ends = np.cumsum(last - first, dtype=np.int32)
        piece = np.searchsorted(np.flatnonzero(b == 10), first)
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[np.int32(0)], ends])), pa.py_buffer(b[~apart])]).dictionary_encode()
        codes = coded.indices.to_numpy()
        bits = np.array([xxhash.xxh3_64_intdigest(w) & 0xFFFF for w in coded.dictionary.to_pylist()], np.uint64)[codes]
        key, words = np.zeros(n, np.uint64), np.full((n, DEPTH), -1, np.int32)
        for k in range(DEPTH):
            at = np.minimum(np.arange(n) + k, len(first) - 1)
            there = (piece[at] == piece[:n]) & (np.arange(n) + k < len(first))
            key |= np.where(there, bits[at], np.uint64(0)) << np.uint64(48 - 16 * k)
            words[:, k] = np.where(there, codes[at], -1)
        yield coded.dictionary, words, key


def counters(key: np.ndarray) -> list[np.ndarray]:
    """Where the prefixes of one to three words are counted, and a number by which whole suffixes are dealt."""
    return [(key >> np.uint64(48)).astype(np.int64), *((_mix((key >> np.uint64(s)) + np.uint64(s + 1)) & np.uint64(COUNTERS - 1)).astype(np.int64) for s in (32, 16, 0))]


def _by_lang(part: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
        texts.setdefault(lang, []).append(text.as_py() or b"")
    yield from texts.items()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(0, null, language, its words) and (depth, counter, null, suffixes) of a task's rows (language, text)."""
    total, words = np.zeros((3, COUNTERS), np.int64), {}
    for part in (part for batch in batches for part in slices(batch, 1)):
        for lang, texts in _by_lang(part):
            for *_, key in suffixes(texts):
                words[lang] = words.get(lang, 0) + len(key)
                for row, at in zip(total, counters(key), strict=False):
                    row += np.bincount(at, minlength=COUNTERS)
    depth, at = np.nonzero(total)
    yield pa.record_batch([np.zeros(len(words), np.int32), pa.nulls(len(words), pa.int64()), pa.array(words, pa.string()), pa.array(words.values(), pa.int64())], ["_d", "_b", "_lang", "_c"])
    yield pa.record_batch([(depth + 1).astype(np.int32), at, pa.nulls(len(at), pa.string()), total[depth, at]], ["_d", "_b", "_lang", "_c"])


def packed(total: np.ndarray, least: int = BUDGET, most: int = GROUPS) -> tuple[list[np.ndarray], int]:
    """For each counter of one to three words its group, or -1 if its prefixes are extended; and the number of groups
    (after those) for whole suffixes. What a group holds at two or three words is at most what the counter says."""
    budget, groups, nodes = max(least, -(-int(total[0].sum()) // most)), 0, []
    over = True
    for row in total:
        sizes = np.where(row > budget, 0, row) if over else np.zeros_like(row)
        nodes.append(np.where(row > budget, -1, groups + np.cumsum(sizes) // budget))
        groups = int(nodes[-1].max()) + 1 if over else groups
        over = over and bool((row > budget).any())
    return nodes, (max(1, -(-int(total[2][total[2] > budget].sum()) // budget)) if over else 0)


#: Leaves of a block whose keys begin alike, in order: for each the words it has in common with the one before and all its
#: words (a byte), its number (four), and its other words, each followed by a space.
_LEAF = "_g long, _k long, _p int, _lang string, _w binary, _c binary, _s binary"
_LEAVES = ["_g", "_k", "_p", "_lang", "_w", "_c", "_s"]


def _cut(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _spelt(names: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words, each followed by a space, and where they begin."""
    offsets = np.frombuffer(names.buffers()[1], np.int32, len(names) + 1, names.offset * 4)
    size = np.diff(offsets)[codes] + 1
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.full(to[-1], 32, np.uint8)
    body = np.frombuffer(names.buffers()[2], np.uint8) if names.buffers()[2] is not None else np.zeros(0, np.uint8)
    for k in range(0, len(codes), 1 << 16):
        n = size[k : k + (1 << 16)] - 1
        own = np.arange(int(n.sum()), dtype=np.int32) - np.repeat((np.cumsum(n) - n).astype(np.int32), n)
        out[own + np.repeat(to[k : k + len(n)], n)] = body[own + np.repeat(offsets[codes[k : k + len(n)]], n)]
    return out, to


def _leaves(nodes: list[np.ndarray], rest: int):
    first_rest = max(int(n.max()) for n in nodes) + 1

    def rows(lang: str, names: pa.Array, words: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((*words.T[::-1], key))
        words, key = words[order], key[order]
        same = np.cumprod(words[1:] == words[:-1], axis=1).sum(1)
        fresh = np.concatenate([[True], same < DEPTH])
        count = np.diff(np.append(np.flatnonzero(fresh), len(key)))
        words, key, same = words[fresh], key[fresh], np.concatenate([[0], same])[fresh]
        at = counters(key)
        group, prefix = np.full(len(key), -1, np.int64), np.full(len(key), DEPTH, np.int64)
        for d, (node, where) in enumerate(zip(nodes, at, strict=False), 1):
            prefix = np.where((group < 0) & (node[where] >= 0), d, prefix)
            group = np.where(group < 0, node[where], group)
        group = np.where(group < 0, first_rest + at[3] % max(1, rest), group)
        shift = (16 * (DEPTH - prefix)).astype(np.uint64)
        key = (key >> shift) << shift
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])]))
        total = (words >= 0).sum(1)
        same = np.minimum(same, total)
        same[start] = 0
        own = (np.arange(DEPTH) >= same[:, None]) & (words >= 0)
        body, to = _spelt(names, words[own])
        ends = np.append(start, len(key))
        before = np.concatenate([[0], np.cumsum(total - same)])
        lang_col = pa.DictionaryArray.from_arrays(np.zeros(len(start), np.int8), pa.array([lang], pa.string())).cast(pa.string())
        return pa.record_batch([group[start], key[start].view(np.int64), prefix[start].astype(np.int32), lang_col, _cut((same | total << 4).astype(np.uint8), ends), _cut(count.astype("<i4").view(np.uint8), ends * 4), _cut(body, to[before[ends]])], _LEAVES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The different suffixes of a block with their number and group."""
        for part in (part for batch in batches for part in slices(batch, 1)):
            for lang, texts in _by_lang(part):
                for names, words, key in suffixes(texts):
                    yield rows(lang, names, words, key)

    return run


def _common(key: np.ndarray, other: np.uint64 | None) -> np.ndarray:
    """How many leading words' bits keys have in common with another one."""
    if other is None:
        return np.zeros(len(key), np.int64)
    x = key ^ other
    return (x < np.uint64(1 << 48)).astype(np.int64) + (x < np.uint64(1 << 32)) + (x < np.uint64(1 << 16)) + (x == 0)


def _joined(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column, and how many each row has."""
    sizes, values = [], []
    for chunk in column.chunks:
        offsets = np.frombuffer(chunk.buffers()[1], np.int32, len(chunk) + 1, chunk.offset * 4)
        sizes.append(np.diff(offsets))
        values.append(np.frombuffer(chunk.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
    return np.concatenate(values).view(kind), np.concatenate(sizes) // np.dtype(kind).itemsize


def tree(rows: pa.Table, shared: np.ndarray, least: int = LEAST) -> pa.RecordBatch:
    """(language, phrase, number) of the nodes over leaves (rows as in _LEAF): those that are as frequent as ``least`` or of
    a depth up to ``shared``, where other parts have leaves, too."""
    (packed_words, each), (count, _), (body, _) = _joined(rows["_w"], "u1"), _joined(rows["_c"], "<i4"), _joined(rows["_s"], "u1")
    same, total = (packed_words & 15).astype(np.int64), (packed_words >> 4).astype(np.int64)
    ends = np.flatnonzero(body == 32).astype(np.int32) + np.int32(1)
    coded = _cut(body, np.concatenate([[0], ends])).dictionary_encode()
    codes, kinds = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    begin = np.cumsum(total - same) - (total - same)
    place, words = np.arange(len(same)), []
    for d in range(DEPTH):
        # A leaf that has the word in common with those before takes that of the last one that spells it.
        spelt = np.maximum.accumulate(np.where(same <= d, place, 0))
        words.append(np.where(total > d, codes[np.minimum(begin[spelt] + d - same[spelt], len(codes) - 1)], -1))
    lang = rows["_lang"].combine_chunks().dictionary_encode()
    at, node = place, np.repeat(lang.indices.to_numpy().astype(np.int64), each)
    shared, row = np.repeat(shared, each), np.repeat(np.arange(len(each)), each)
    langs, phrases, numbers = [], [], []
    for d in range(1, DEPTH + 1):
        longer = words[d - 1][at] >= 0
        at, node = at[longer], node[longer]
        if not len(at):
            break
        _, one, node = np.unique(node * kinds + words[d - 1][at], return_index=True, return_inverse=True)
        sums = np.bincount(node, count[at]).astype(np.int64)  # exact up to 2^53
        part = np.zeros(len(one), bool)
        part[node[shared[at] >= d]] = True
        out = np.flatnonzero((sums >= least) | part)
        leaf = at[one[out]]
        langs.append(lang.indices.to_numpy()[row[leaf]])
        text, to = _spelt(coded.dictionary, np.stack([words[k][leaf] for k in range(d)], 1).ravel())
        keep = np.ones(len(text), bool)
        keep[to[1:] - 1] = False  # a word has a space of its own; that of a phrase's last one goes, too
        keep[to[d::d] - 2] = False
        phrases += _cut(text[keep], np.concatenate([[0], np.cumsum(keep)[to[d::d] - 1]])).to_pylist()
        numbers.append(sums[out])
        go = ((sums >= least) | part)[node]
        at, node = at[go], node[go]
    return pa.record_batch([lang.dictionary.take(pa.array(np.concatenate([np.zeros(0, np.int32), *langs]), pa.int32())), pa.array(phrases, pa.binary()).cast(pa.string()), np.concatenate([np.zeros(0, np.int64), *numbers])], ["_lang", "_phrase", "_f"])


def _trees(least: int, leaves: int = LEAVES):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nodes of leaves sorted by key, some at once: cut where the first word's bits change, or, within one that has more, the
        first two words', and so on; where one key has very many, anywhere."""
        held: list[pa.RecordBatch] = []
        before: np.uint64 | None = None

        def nodes(rows: pa.Table, after: np.uint64 | None) -> pa.RecordBatch:
            key = rows["_k"].to_numpy().view(np.uint64)
            return tree(rows, np.maximum(rows["_p"].to_numpy() - 1, np.maximum(_common(key, before), _common(key, after))), least)

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column(4))).as_py()
            if size < leaves:
                continue
            rows = pa.Table.from_batches(held)
            key = rows["_k"].to_numpy().view(np.uint64)
            change = key[1:] ^ key[:-1]
            cuts = next((c for s in (48, 32, 16, 0) if len(c := np.flatnonzero(change >> np.uint64(s)))), None)
            cut = int(cuts[-1]) + 1 if cuts is not None else len(key) - 1 if size >= 8 * leaves else 0
            if cut:
                yield nodes(rows.slice(0, cut), key[cut])
                before = key[cut - 1]
                held = rows.slice(cut).combine_chunks().to_batches()
                size = sum(pc.sum(pc.binary_length(b.column(4))).as_py() for b in held)
        if held:
            yield nodes(pa.Table.from_batches(held), None)

    return run


def phrases(df: DataFrame, scratch: Scratch, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, budget: int = BUDGET, leaves: int = LEAVES) -> tuple[DataFrame, DataFrame]:
    """(_lang, _phrase, _m words, _f) of all phrases of one to four words as frequent as ``least``, and (_lang, n words)."""
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    with small_batches(df.sparkSession):
        counted = scratch.written(docs.mapInArrow(_count, "_d int, _b long, _lang string, _c long"), "counters")
    total = np.zeros((3, COUNTERS), np.int64)
    # As many rows as there are counters, at most.
    for d, b, c in counted.filter("_d > 0").groupBy("_d", "_b").agg(F.sum("_c")).collect():
        total[d - 1, b] = c
    words = counted.filter("_d = 0").groupBy("_lang").agg(F.sum("_c").alias("n"))
    with small_batches(df.sparkSession):
        dealt = docs.mapInArrow(_leaves(*packed(total, budget)), _LEAF).repartition("_g").sortWithinPartitions("_k")
        nodes = dealt.mapInArrow(_trees(least, leaves), "_lang string, _phrase string, _f long").groupBy("_lang", "_phrase").agg(F.sum("_f").alias("_f"))
        found = scratch.written(nodes.filter(F.col("_f") >= least).withColumn("_m", F.size(F.split("_phrase", " "))), "phrases")
    return found, words


def _top(df: DataFrame, top: int) -> DataFrame:
    """The first rows of each language with their rank, first in parts, so that no task sorts a whole language."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = df.withColumn("_r", F.row_number().over(part.orderBy(*order))).filter(F.col("_r") <= top).drop("_r")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def _words(phrase: Column, first: int | Column, n: int | Column) -> Column:
    return F.concat_ws(" ", F.slice(F.split(phrase, " "), first, n))


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, budget: int = BUDGET, leaves: int = LEAVES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two to four words.

    A-Z are lower-cased; pieces end at `[.,;:!?\\x0A-\\x0D]` and words are `[^\\x20\\x09]+`. ``a`` is the phrase's number, at
    least ``least``; of its cuts in two the one with the smallest floor(2000000 a / (l + r)), then the shortest first part, gives ``l``,
    ``r`` and the score. A phrase goes if a longer one that holds its words in a row occurs 0.8 times as often or
    more. ``n`` counts the language's words. A null language is `und`, a null text is empty; rows that repeat count as often as they
    are there. Tables without a frequent phrase give no rows. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession)
    found, words = phrases(df, scratch, lang_col, text_col, least, budget, leaves)
    many = found.filter("_m > 1")
    cuts = many.withColumn("_at", F.explode(F.sequence(F.lit(1), F.col("_m") - 1)))
    cuts = cuts.withColumn("_first", _words(F.col("_phrase"), F.lit(1), F.col("_at"))).withColumn("_rest", _words(F.col("_phrase"), F.col("_at") + 1, F.col("_m")))
    part = lambda side: found.select(F.col("_lang").alias(f"_{side}lang"), F.col("_phrase").alias(f"_{side}"), F.col("_f").alias(side))
    on = lambda side, col: (F.col("_lang") == F.col(f"_{side}lang")) & (F.col(col) == F.col(f"_{side}"))
    cuts = cuts.join(part("l"), on("l", "_first")).join(part("r"), on("r", "_rest"))
    # Products may pass 64 bits; the quotient is the whole part of an exact division.
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(19,0)) * CAST(_f AS DECIMAL(19,0))) div CAST(l + r AS DECIMAL(38,0))")
    least_cut = cuts.withColumn("_score", score).groupBy("_lang", "_phrase", "_f").agg(F.min(F.struct("_score", "_at", "l", "r")).alias("c"))
    inner = many.filter("_m > 2").withColumn("_len", F.explode(F.sequence(F.lit(2), F.col("_m") - 1))).withColumn("_from", F.explode(F.sequence(F.lit(1), F.col("_m") - F.col("_len") + 1)))
    held = inner.groupBy(F.col("_lang").alias("_hlang"), _words(F.col("_phrase"), F.col("_from"), F.col("_len")).alias("_h")).agg(F.max("_f").alias("_longer"))
    kept = least_cut.join(held, (F.col("_lang") == F.col("_hlang")) & (F.col("_phrase") == F.col("_h")), "left")
    kept = kept.filter(F.col("_longer").isNull() | (100 * F.col("_longer") < COVER * F.col("_f")))
    kept = kept.select(F.col("_lang").alias("lang"), F.col("_phrase").alias("phrase"), F.col("_f").alias("a"), F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c._score").alias("score"))
    out = written(_top(kept, top).join(words.withColumnRenamed("_lang", "_wlang"), F.col("lang") == F.col("_wlang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    scratch.clear()
    return out
