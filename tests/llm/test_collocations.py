"""Phrase counts, cuts and ranks against brute force, with groups, blocks and trees so small that every border is met."""

import random
from collections import Counter

import pytest

from scholion.llm import collocations as C
from scholion.llm.common import Scratch

WORDS = ["a", "bb", "ccc", "dé", "e\x01", "THE", "of", "x\x1f"]


def made(n, seed=5):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", "\t", "\n"]) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def counts(rows):
    found, words = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        c = found.setdefault(lang, Counter())
        for piece in (text or "").encode().translate(C._PLAIN).split(b"\n"):
            w = [x.decode() for x in piece.split(b" ") if x]
            words[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, 5):
                    if i + m <= len(w):
                        c[tuple(w[i : i + m])] += 1
    return found, words


def brute(rows, least, top):
    out = []
    found, words = counts(rows)
    for lang, f in found.items():
        many = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        ranked = []
        for p, a in many.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in many.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, words[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("budget", "leaves"), [(C.BUDGET, C.LEAVES), (300, 40), (5, 3)])
def test_against_brute_force(spark, budget, leaves):
    texts = made(60)
    rows = [(random.Random(k).choice(["en", None, "und", "fr"]), t) for k, t in enumerate(texts)] + [("en", None), ("en", ""), ("zz", "..."), ("en", texts[0]), ("en", "w" * 3_000_000)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "lang string, text string, phrase string, n int, _f int").repartition(5)
    got = C.collocations(df, least=4, top=30, budget=budget, leaves=leaves).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 4, 30)


def test_nodes_and_groups(spark):
    rows = [("en", t) for t in made(30, 8)]
    df = spark.createDataFrame(rows, "lang string, text string")
    f, _ = C.phrases(df, Scratch(spark), least=3, budget=20, leaves=7)
    want = {" ".join(p): n for p, n in counts(rows)[0]["en"].items() if n >= 3}
    assert {r["_phrase"]: r["_f"] for r in f.collect()} == want


@pytest.mark.parametrize("step", [1 << 21, 60, 7])
def test_blocks_lose_no_suffix(step):
    texts = [t.encode() for t in made(20, 9)]
    got = Counter()
    for names, words, _ in C.suffixes(texts, step):
        names = names.to_pylist()
        for row in words.tolist():
            w = tuple(names[k].decode() for k in row if k >= 0)
            got.update(w[:m] for m in range(1, len(w) + 1))
    assert got == counts([("en", t.decode()) for t in texts])[0]["en"]


def test_groups_stay_in_budget():
    import numpy as np

    total = np.zeros((3, C.COUNTERS), np.int64)
    total[0, :8], total[1, :4], total[2, :2] = [1, 2, 30, 4, 5, 6, 7, 8], [20, 3, 4, 3], [19, 1]
    nodes, rest = C.packed(total, 10)
    assert nodes[0][2] == nodes[1][0] == nodes[2][0] == -1 and rest == 2
    sizes = np.bincount(nodes[0][nodes[0] >= 0], total[0][nodes[0] >= 0])
    assert sizes.max() < 20 and nodes[1].max() > nodes[0].max()


def test_empty(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(df).count() == 0
