"""Components of the LSH forest against brute force, in blocks of any size."""

import random

import numpy as np
import pytest

from scholion.llm import lsh_forest as L
from scholion.llm.common import shingle_hashes

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    n = min(3, len(w))
    return frozenset(b" ".join(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()


def brute(rows):
    """(id, size, component, kept) of rows, several rows of an id being one document."""
    rows = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    named = [(i, s) for i, s in rows if i is not None and s]
    for k, (i, a) in enumerate(named):
        for j, b in named[:k]:
            n = len(a & b)
            if root(i) != root(j) and 100 * n >= 85 * (len(a) + len(b) - n):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    out = [(i, len(s), None if i is None else root(i) if s else i) for i, s in rows]
    return sorted(map(str, ((i, n, c, i == c) for i, n, c in out)))


def family(rng, n, size, most):
    base = [f"w{rng.randrange(4000)}" for _ in range(size)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(size)] = f"v{rng.randrange(9000)}"
        yield " ".join(w)


def documents():
    rng = random.Random(11)
    texts = [*family(rng, 60, 150, 9), *family(rng, 25, 30, 2), *family(rng, 10, 9, 1), *family(rng, 4, 4, 1)]
    texts += texts[:6] + [texts[3].upper(), "", " \t\n", "one", "one", "one two", "Ä ä x", "ä ä x"]
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


def check(spark, rows, **sizes):
    df = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], "doc_id long, text string, kept int, n_shingles int, _key string").repartition(4)
    got = L.near_duplicates(df, **sizes).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


@pytest.mark.parametrize("sizes", [{}, {"block": 900, "passing": 2000}])
def test_against_brute_force(spark, sizes):
    rows = documents()
    several = [(101, rows[40][1]), (102, rows[2][1]), (102, "nothing like it at all, said they, and left"), (None, rows[5][1]), (None, None), (900, None)]
    check(spark, rows + several, **sizes)


def test_long_words_and_empty(spark):
    """Words that polynomial hashes confuse are two words."""
    word = "a"
    for _ in range(10):
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    check(spark, [(1, word), (2, other), (3, "x " * 200_000), (4, "x " * 200_001)])
    assert L.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_span_components():
    rng = random.Random(2)
    sets = [shingle_hashes(t.encode(), 3) for t in dict.fromkeys(family(rng, 80, 120, 8))]
    links = list(L.links_inside(sets))
    assert len(links) < len(sets)
    for a, b in links:
        n = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n)


def test_neighbours_of_tasks():
    import pyarrow as pa

    rows = [(b"\0" + b"abcdefgh" + bytes([k]) * 8, k) for k in range(4)] + [(b"\1" + b"abcdefgh" + bytes(8), 9)]
    batch = pa.record_batch([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], ["_o", "_u"])
    whole = [r for b in L._neighbours(iter([batch])) for r in b.to_pylist()]
    assert [(r["_u"], r["_v"]) for r in whole if r["_v"] is not None] == [(0, 1), (1, 2), (2, 3)]
    assert [r["_u"] for r in whole if r["_v"] is None] == [0, 9]
