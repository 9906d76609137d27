"""The Jaccard join against brute force, and its parts on hard inputs."""

import random
import re

import numpy as np
import pyarrow as pa

from scholion.llm import jaccard_join as J
from scholion.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and root(a) != root(b):
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choice(vocab) for _ in range(30))
    base = [" ".join(rng.choice(vocab) for _ in range(rng.choice([6, 20, 60, 150]))) for _ in range(60)]
    rows = [(i, t if i % 3 else f"{line} {t}") for i, t in enumerate(base)]
    hot = [rng.choice(vocab) for _ in range(120)]
    for i in range(60, 330):
        if i % 2:
            words = hot[:]
        else:
            words = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one two"), (404, "ONE  Two"), (405, "one"), (406, rows[5][1].upper()), (407, "é É"), (408, "x " * 30000), (409, "y" * 600_000 + " z"), (410, "Y" * 600_000 + " Z")]
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "MEMBERS", 4)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _n int")
    got = sorted(tuple(r)[:3] for r in J.near_duplicates(df).collect())
    assert got == brute(rows)


def test_sample_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert sorted(tuple(r)[:3] for r in J.near_duplicates(df).collect()) == brute(rows)


def test_small_groups(spark, monkeypatch):
    """Leading sets with more members than a group holds, and texts dealt by id."""
    monkeypatch.setattr(J, "MEMBERS", 2)
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(J, "LEADERS", 1)
    monkeypatch.setattr(J, "WAITING", 3)
    rows = corpus()
    assert sorted(tuple(r)[:3] for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute(rows)


def test_different_texts_of_an_id(spark):
    a, b = "a b c d e f g h i j k l m n", "o p q r s t u v w x y z aa bb"
    rows = [(5, a), (5, b), (6, a + " x"), (7, b + " x"), (8, "other words stand here and no more")]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 10): 5, (6, 11): 5, (7, 11): 5, (8, 3): 8}


def test_repeated_rows_null_ids_and_no_rows(spark):
    t = "a b c d e f g h i j k l m n"
    rows = [(5, t), (5, t), (None, t), (7, t + " o"), (8, None)]
    got = sorted((tuple(r)[:3] for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 10, 5), (5, 10, 5), (None, 10, None), (7, 11, 5), (8, 0, 8)], key=str)
    assert J.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_groups_that_may_link():
    """Rows of the two sides that share enough of their indexed shingles, across groups and batches."""
    rng = random.Random(4)
    rows, want = [], set()
    bits = lambda x: J.bitmap(np.array(x, np.int64) * 77)
    for g in range(12):
        sides = [], []
        for i in range(rng.randint(0, 9)):
            sides[i % 2].append((g * 100 + i, rng.randint(4, 30), sorted(rng.sample(range(12), rng.randint(1, 8)))))
        for a, n, x in sides[0]:
            for b, m, y in sides[1]:
                both = len(set(x) & set(y))
                after = max((3 * n + 3) // 4, (3 * m + 3) // 4) - 1
                if both and 7 * (both + after) >= 3 * (n + m) and 4 * min(n, m) >= 3 * max(n, m) and 7 * (len(set(x) - set(y)) + len(set(y) - set(x))) <= n + m:
                    want |= {(g, 0, a), (g, 1, b)}
        rows += [(1, 2, g, 3, k, 7, i, n, x, bits(x)) for k in (0, 1) for i, n, x in sides[k]]
    assert want
    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), [pa.int64()] * 4 + [pa.int32()] + [pa.int64()] * 2 + [pa.int32(), pa.list_(pa.int64()), pa.binary()])]
    whole = pa.record_batch(columns, [*J._ROW, "_n", "_hs", "_bits"])
    for size in (1, 3, 100):
        got = [(r["_g"], r["_side"], r["_id"]) for b in J._could(whole.slice(i, size) for i in range(0, len(rows), size)) for r in b.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want


def test_bitmaps_never_tell_too_much():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(-(1 << 62), 1 << 62, n)) for n in (0, 1, 5, 100, 100, 700, 3000)]
    sets += [np.union1d(sets[3], sets[4][:20]), sets[5][50:], np.union1d(sets[5], sets[3])]
    as_bits = lambda s: np.frombuffer(J.bitmap(s), np.uint8)
    for x in sets:
        for y in sets:
            assert J.differences(as_bits(x), as_bits(y)) <= len(np.setdiff1d(x, y))
    batch = pa.record_batch([pa.array([1] * 3 + [2] * 2, pa.int64()), pa.array([0] * 5, pa.int64()), pa.array([len(sets[k]) for k in (5, 8, 9, 3, 7)], pa.int64()), pa.array([J.bitmap(sets[k]) for k in (5, 8, 9, 3, 7)], pa.binary())], ["c", "b", "_n", "_bits"])
    for size in (1, 2, 5):
        one, two = [r for b in J._summaries(batch.slice(k, size) for k in range(0, 5, size)) for r in b.to_pylist()]
        some, every = (np.frombuffer(one[k], np.uint8) for k in ("some", "every"))
        assert all(J.differences(as_bits(sets[k]), some) == 0 == J.differences(every, as_bits(sets[k])) for k in (5, 8, 9)) and one["most"] == len(sets[9])
        least = min(len(np.setdiff1d(sets[a], sets[b])) for a in (5, 8, 9) for b in (3, 7))
        assert 0 < J.differences(every, np.frombuffer(two["some"], np.uint8)) <= least


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 400)], "u long, v long").repartition(8)
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {400: 400, 500: 400}


def test_shared_entries_across_batches():
    h = np.array([1, 2, 2, 2, 3, 3, 4, 4, 4, 4, 5], np.int64)
    key = np.array([1, 1, 1, 2, 1, 1, 1, 2, 2, 3, 1], np.int64)
    whole = pa.record_batch({"_h": h, "_key": key, "_n": np.ones(11, np.int32), "_pos": np.zeros(11, np.int32)})
    want = [(2, 1), (2, 2), (4, 1), (4, 2), (4, 3)]
    for size in range(1, 12):
        parts = [whole.slice(i, size) for i in range(0, 11, size)]
        got = [(r["_h"], r["_key"]) for b in J._shared(iter(parts)) for r in b.to_pylist()]
        assert got == want, size


def test_words_of_two_letters_in_turn(spark):
    """Polynomial hashes modulo a power of two confuse these words."""
    word = "a"
    for _ in range(10):
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    assert not set(J.shingle_set(word)) & set(J.shingle_set(other))
    df = spark.createDataFrame([(1, word), (2, other), (3, f"x y z u {word}"), (4, f"x y z u {other}")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in J.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_an_id_of_many_rows(spark):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join(["first", *words[1:]]), " ".join([*words[:-1], "last"])]
    df = spark.createDataFrame([(5, texts[k % 2]) for k in range(10_000)] + [(3, texts[2]), (9, "something else that is not like it")], "doc_id long, text string").repartition(8)
    got = {(r["doc_id"], r["component_id"]) for r in J.near_duplicates(df).collect()}
    assert got == {(5, 3), (3, 3), (9, 9)}
