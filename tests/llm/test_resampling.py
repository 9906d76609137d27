"""Weights, noise and ranks against brute force."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest

from scholion.llm import resampling as R
from scholion.llm.common import Scratch

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def brute(rows, target):
    have, want = Counter(), Counter()
    for _, t in rows:
        have.update(features(t)[1])
    for t in target:
        want.update(features(t)[1])
    s, t = sum(have.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (s + 10_000) / ((have[b] + 1) * (t + 10_000))))
    out = []
    for i, text in rows:
        w, f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= 20])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = fit[: 25 * len(fit) // 100]
    return sorted((str((*r[:4], next((k for k, d in enumerate(drawn, 1) if d is r), None))) for r in out))


TEXTS = [" ".join(f"w{k * j % 17}" if j % 3 else "Ärger-x" for j in range(5 + k % 60)) for k in range(120)]


@pytest.mark.parametrize("reach", [R.REACH, 1e-9])
def test_against_brute_force(spark, reach, monkeypatch):
    monkeypatch.setattr(R, "REACH", reach)  # a bracket that is too narrow is widened
    rows = [*enumerate(TEXTS), (7, TEXTS[50]), (None, TEXTS[40]), (None, None), (500, ""), (501, "?!"), (502, "q" * 3_000_000 + " b " * 30)]
    df = spark.createDataFrame([(i, t, 1, 2, "s") for i, t in rows], "doc_id long, text string, score int, rank int, weight string").repartition(6)
    target = spark.createDataFrame([("w1 w2 w3",), (None,), ("w5 w10",)], "text string")
    got = R.resample(df, target).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, ["w1 w2 w3", None, "w5 w10"])


def test_repeated_rows_at_the_cutoff(spark):
    df = spark.createDataFrame([(1, TEXTS[50])] * 41, "doc_id long, text string")
    ranks = sorted(r["rank"] for r in R.resample(df, df.limit(1)).collect() if r["rank"])
    assert ranks == list(range(1, 11))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert R.resample(none, some).count() == 0
    assert [tuple(r)[:3] for r in R.resample(some, none).collect()] == [(1, 3, -693)]


def test_ranks_over_ranges(spark):
    df = spark.createDataFrame([(k * 7 % 50, k) for k in range(500)], "score long, _id long").repartition(9)
    got = sorted(tuple(r) for r in R.ranked(df, Scratch(spark)).select("rank", "score", "_id").collect())
    want = sorted(((k * 7 % 50, k) for k in range(500)), key=lambda r: (-r[0], r[1]))
    assert got == [(n, *r) for n, r in enumerate(want, 1)]


@pytest.mark.parametrize("step", [1 << 20, 9])
def test_pieces_keep_pairs(step, monkeypatch):
    monkeypatch.setattr(R, "_STEP", step)
    got = [x for part in R.features(TEXTS[33].encode()) for x in part.tolist()]
    assert Counter(got) == Counter(features(TEXTS[33])[1])
