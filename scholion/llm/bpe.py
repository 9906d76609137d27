"""Byte-level BPE encoding and decoding by monoid tree reduction.

Token sequences of byte strings form a monoid: to join the sequences of two neighbours, only a window
around their boundary is encoded again. The window grows until both of its edges are *settled*: a
pair of neighbouring tokens is settled when encoding the two together gives the same two tokens. A
sequence all of whose neighbouring pairs are settled is the encoding of its bytes, so once both edges
are, no token outside the window can change. A long stretch is encoded by halves, recursively, and
the halves are joined up the tree; the matches of the splitting pattern are independent by
definition, so joining them is plain concatenation. Decoding concatenates byte strings, at places that a
running sum of their lengths tells.

Leaves of the same length are merged together, as the rows of a matrix that loses a column with each round.

Each document is one row's work, so the job is a single map without a shuffle; a worker holds one
small Arrow batch, the vocabulary and a bounded cache of stretches that it has met before.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.functions.batches import bounded_batches
from scholion.llm.common import slices

LEAF = 24
CACHE = 100_000
NONE = 1 << 60
BLOCK = 1 << 16
#: Bytes of texts whose stretches are in memory at once (a text at least, but no more than BLOCK * 8 characters of it), and
#: ids that are decoded together.
PART, IDS = 1 << 20, 1 << 18


class Bpe:
    """Ranks, and the encoding of one stretch. ``encode`` joins halves; ``merge`` is the leaf's loop, and ``encode_leaves`` the
    same for many leaves at once."""

    def __init__(self, ranks: dict[bytes, int], pairs: Pairs | None = None) -> None:
        self.ranks, self.pairs = ranks, pairs
        self.settled: dict[tuple[bytes, bytes], bool] = {}

    def merge(self, piece: bytes) -> list[bytes]:
        """Merge the neighbouring pair of the lowest rank, leftmost first, until none is left."""
        if len(piece) > 4 * LEAF:
            return self.merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = self.ranks.get
        ranks = [rank(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            both = parts[i] = parts[i] + parts[i + 1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(both + parts[i + 1], NONE)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + both, NONE)
        return parts

    def merge_long(self, piece: bytes) -> list[bytes]:
        """The same with a queue, for windows that had to grow."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        rank = self.ranks.get
        queue = [(r, i) for i in range(len(parts) - 1) if (r := rank(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            j = after[i] if parts[i] else len(parts)
            if j >= len(parts) or rank(parts[i] + parts[j]) != r:
                continue
            parts[i], parts[j] = parts[i] + parts[j], b""
            after[i] = k = after[j]
            if k < len(parts):
                before[k] = i
                if (s := rank(parts[i] + parts[k])) is not None:
                    heapq.heappush(queue, (s, i))
            if (h := before[i]) >= 0 and (s := rank(parts[h] + parts[i])) is not None:
                heapq.heappush(queue, (s, h))
        return [p for p in parts if p]

    def is_settled(self, a: bytes, b: bytes) -> bool:
        key = (a, b)
        known = self.settled.get(key)
        if known is None:
            if len(self.settled) >= CACHE:
                self.settled.clear()
            known = self.settled[key] = self.merge(a + b) == [a, b]
        return known

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of two neighbours from the encodings of each."""
        if not left or not right or self.is_settled(left[-1], right[0]):
            return left + right
        i, j, step_i, step_j = len(left) - 1, 1, 1, 1
        while True:
            window = self.merge(b"".join(left[i:] + right[:j]))
            left_open = i > 0 and not self.is_settled(left[i - 1], window[0])
            right_open = j < len(right) and not self.is_settled(window[-1], right[j])
            if not left_open and not right_open:
                return left[:i] + window + right[j:]
            if left_open:
                i, step_i = max(0, i - step_i), step_i * 2
            if right_open:
                j, step_j = min(len(right), j + step_j), step_j * 2

    def tree(self, piece: bytes) -> list[bytes]:
        if len(piece) <= LEAF:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one match of the pattern; a match that is a token as a whole is that token."""
        whole = self.ranks.get(piece)
        return (whole,) if whole is not None else tuple(self.ranks[p] for p in self.tree(piece))


    def encode_leaves(self, leaves: list[bytes]) -> list[tuple[int, ...]]:
        """``encode`` of each of ``leaves``, none of them empty or longer than ``LEAF``."""
        if self.pairs is None:
            return list(map(self.encode, leaves))
        out: list = [None if whole is None else (whole,) for whole in map(self.ranks.get, leaves)]
        by_length: dict[int, list[int]] = {}
        for n, leaf in enumerate(leaves):
            if out[n] is None:
                by_length.setdefault(len(leaf), []).append(n)
        for length, at in by_length.items():
            text = np.frombuffer(b"".join([leaves[n] for n in at]), np.uint8).reshape(-1, length)
            for rows, ids in self.pairs.merge(text):
                for row, found in zip(rows.tolist(), ids.tolist(), strict=True):
                    out[at[row]] = tuple(found)
        return out


class Pairs:
    """The neighbouring tokens that merge, and into which: sorted keys of two ids, and the id of both together."""

    NONE = np.int32(np.iinfo(np.int32).max)

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = max(ranks.values()) + 1
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        get = ranks.get
        found = [(a * self.size + b, both) for token, both in ranks.items() for i in range(1, len(token)) if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None]
        table = np.array(found, np.int64).reshape(-1, 2)
        table = table[np.argsort(table[:, 0])]
        self.keys, self.ids = np.append(table[:, 0], np.iinfo(np.int64).max), np.append(table[:, 1].astype(np.int32), self.NONE)

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Pairs | None:
        """None if some byte is no token, or ids are too large; stretches are then encoded one by one."""
        fits = ranks and min(ranks.values()) >= 0 and max(ranks.values()) < cls.NONE
        return cls(ranks) if fits and all(bytes([b]) in ranks for b in range(256)) else None

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of pairs of tokens, NONE where a pair is no token."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ids[at], self.NONE)

    def merge(self, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of ``text`` (bytes, of one length) and their ids, once no pair of them merges. In each round every row merges its
        pair of the lowest rank, leftmost first, so that all rows lose one column."""
        rows, ids = np.arange(len(text)), self.bytes[text]
        pairs = self.joined(ids[:, :-1], ids[:, 1:])
        while len(rows) and pairs.shape[1]:
            at, each = pairs.argmin(1), np.arange(len(rows))
            least = pairs[each, at]
            if (least == self.NONE).any():
                some = least != self.NONE
                yield rows[~some], ids[~some]
                rows, ids, pairs, at, least = rows[some], ids[some], pairs[some], at[some], least[some]
                each = np.arange(len(rows))
            n, width = ids.shape
            stays, kept = np.ones((n, width), bool), np.ones((n, width - 1), bool)
            stays[each, at + 1], kept[each, at] = False, False
            ids[each, at] = least
            ids, pairs = ids[stays].reshape(n, width - 1), pairs[kept].reshape(n, width - 2)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            pairs[before, at[before] - 1] = self.joined(ids[before, at[before] - 1], ids[before, at[before]])
            pairs[after, at[after]] = self.joined(ids[after, at[after]], ids[after, at[after] + 1])
        if len(rows):
            yield rows, ids


class _Cached(dict):
    """Ids by stretch of text, for stretches met before. When it is full, its entries become the old
    ones, of which those that are met again come back and the rest is forgotten at the next turn; the turn comes
    between two texts, or parts of one, so that what one of them needs stays while it is encoded."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe = bpe
        self.old: dict[str, tuple[int, ...]] = {}

    def __missing__(self, stretch: str) -> tuple[int, ...]:
        ids = self.old.pop(stretch, None) or self.bpe.encode(stretch.encode())
        if len(stretch) <= 64:
            self[stretch] = ids
        return ids

    def learn(self, stretches: Iterable[str]) -> None:
        """Encodes those of ``stretches`` together that are leaves and not known yet."""
        new = set(stretches).difference(self)
        if len(self) + len(new) > CACHE:
            self.old = dict(self)
            self.clear()
        new = [s for s in new if len(s) <= LEAF and s not in self.old]
        leaves = [(s, b) for s, b in zip(new, map(str.encode, new), strict=True) if 0 < len(b) <= LEAF]
        self.update(zip([s for s, _ in leaves], self.bpe.encode_leaves([b for _, b in leaves]), strict=True))


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its rank."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in content.splitlines() if line)}


def encode_text(text: str, find: regex.Pattern, ids: _Cached) -> Iterator[int]:
    if len(text) <= BLOCK * 8:
        found = find.findall(text)
        ids.learn(found)
        return chain.from_iterable(map(ids.__getitem__, found))
    return chain.from_iterable(_encoded_blocks(text, find, ids))


def _encoded_blocks(text: str, find: regex.Pattern, ids: _Cached) -> Iterator[Iterator[int]]:
    stretches = (m.group() for m in find.finditer(text))
    while found := list(islice(stretches, BLOCK)):
        ids.learn(found)
        yield chain.from_iterable(map(ids.__getitem__, found))


def _encoded(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int], pattern: str, pairs: Pairs | None = None) -> Iterator[pa.RecordBatch]:
    """(_id, ids) of batches (id, text)."""
    ids, find = _Cached(Bpe(ranks, pairs)), regex.compile(pattern)
    for part in (part for batch in batches for part in slices(batch, 1, PART)):
        texts = [t.as_py() or "" for t in part.column(1)]
        if len(texts) > 1:  # of so many bytes in all
            found = [find.findall(t) for t in texts]
            ids.learn(chain.from_iterable(found))
            lists = [pa.array(np.fromiter(chain.from_iterable(map(ids.__getitem__, f)), np.int32)) for f in found]
        else:
            lists = [pa.array(np.fromiter(encode_text(t, find, ids), np.int32)) for t in texts]
        yield pa.record_batch([part.column(0), _lists(lists, pa.int32())], ["_id", "ids"])


class _Tokens:
    """The bytes of all tokens, and where those of an id start and how many they are."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.starts, self.sizes = np.zeros(max(ranks.values(), default=-1) + 1, np.int64), np.full(max(ranks.values(), default=-1) + 1, -1, np.int64)
        at = np.fromiter(ranks.values(), np.int64, len(ranks))
        self.sizes[at] = np.fromiter(map(len, ranks), np.int64, len(ranks))
        self.starts[at] = np.cumsum(self.sizes[at]) - self.sizes[at]
        self.text = np.frombuffer(b"".join(ranks), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ``ids``, concatenated, and where each of them ends; an id without a token is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or self.sizes[ids].min() < 0):
            raise KeyError(next(i for i in ids.tolist() if not 0 <= i < len(self.sizes) or self.sizes[i] < 0))
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.text[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ids) else 0)], ends


def _decoded(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int], at: int) -> Iterator[pa.RecordBatch]:
    """Batches with the bytes of the ids in column ``at``."""
    tokens = _Tokens(ranks)
    for part in (part for batch in batches for part in slices(batch, at, IDS)):
        lists = part.column(at)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        if lists.flatten().null_count:
            raise KeyError(None)
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        found = [tokens.decode(ids[start : start + IDS]) for start in range(0, max(1, len(ids)), IDS)]
        ends = np.concatenate([[0], *(e + before for (_, e), before in zip(found, np.cumsum([0, *(len(t) for t, _ in found)]), strict=False))])
        ends = ends[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])]
        if ends[-1] > np.iinfo(np.int32).max:
            raise OverflowError("the bytes of a text exceed what a row can hold")
        valid = None if not lists.null_count else pa.array(lists.is_valid().to_pylist()).buffers()[1]
        out = pa.Array.from_buffers(pa.binary(), len(lists), [valid, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.concatenate([t for t, _ in found]))], lists.null_count)
        yield pa.record_batch([*part.columns, out], [*part.schema.names, "decoded"])


def _vocabulary(df: DataFrame, ranks_path: str):
    """A broadcast vocabulary file, and its pairs that merge."""
    bounded_batches(df.sparkSession)
    with open(ranks_path, "rb") as f:
        content = f.read()
    return df.sparkSession.sparkContext.broadcast((content, Pairs.of(parse_ranks(content))))


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row of ``df``: the token ids of the whole text.

    A null or empty text has an empty list. Ids of rows are carried as they are, null and repeated
    ones too; other columns are not read. ``ranks_path`` is a file of base64 tokens and ranks, read
    once by the driver and sent to the workers (a vocabulary, so of fixed size); ``pattern`` splits a
    text into stretches that are encoded separately.
    """
    content, kind = _vocabulary(df, ranks_path), dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, pairs = content.value
        return _encoded(batches, parse_ranks(vocabulary), pattern, pairs)

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with a column ``decoded`` (binary): the bytes of the ids, concatenated. Null ids give
    null bytes; an id that the vocabulary lacks is an error."""
    content, at = _vocabulary(df, ranks_path), df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(batches, parse_ranks(content.value[0]), at)

    return df.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), "decoded binary"]))


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode`` of ``encode``, (id, ids, decoded), in one pass: a task has one Python worker and one vocabulary, and
    ids do not go back and forth between them."""
    content, kind = _vocabulary(df, ranks_path), dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, pairs = content.value
        ranks = parse_ranks(vocabulary)
        return _decoded(_encoded(batches, ranks, pattern, pairs), ranks, 1)

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, ids array<int>, decoded binary").withColumnRenamed("_id", id_col)


def _lists(values: list[pa.Array], kind: pa.DataType) -> pa.ListArray:
    ends = [0]
    for v in values:
        ends.append(ends[-1] + len(v))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(values) if values else pa.array([], kind))
