"""Repeated passages against brute force, and the parts of the suffix order."""

import random

import numpy as np
import pytest

from scholion.llm import suffix_dedup as S


def brute(rows):
    seen, out = set(), []
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(b)))
        out.append((i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out)


def corpus():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    shared = [text(n) for n in (60, 99, 100, 101, 140, 400)]
    rows = []
    for i in range(150):
        parts = [text(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), text(rng.choice([0, 3, 80]))]
        rows.append((i * 3, "".join(parts)))
    rows += [(1000, rows[3][1]), (1001, None), (1002, ""), (1003, "a" * 700), (1004, "a" * 99), (1005, "ab" * 200), (1006, "ba" * 150), (-5, rows[7][1] + "x")]
    rows += [(2000 + i, shared[4] + text(50)) for i in range(40)]
    return rows


@pytest.mark.parametrize("hot", [2000, 5, 1])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rows = corpus()
    got = S.remove_repeats(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, spans int").repartition(5)).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == brute(rows)


def test_sample_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = S.remove_repeats(df).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == brute(rows)


def test_repeated_rows_null_ids_and_no_rows(spark):
    t = "".join(chr(97 + k * k % 26) for k in range(200)) + "".join(map(str, range(200)))
    rows = [(1, t), (1, t), (None, t), (2, t)]
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["n_removed"]) for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(False, 1, brute([(1, t)])[0][2])] * 2 + [(False, 2, len(t)), (True, None, 0)], key=str)
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_different_texts_of_an_id(spark):
    """Each is a document of its own; repeated rows are one."""
    rng = random.Random(6)
    a, b, c = ("".join(rng.choice("abcdefg") for _ in range(160)) for _ in range(3))
    rows = [(1, a), (2, b + c), (2, "x" + a), (2, b + c), (3, c)]
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 160): 0, (2, 320): 0, (2, 161): 160, (3, 160): 160}


def test_a_long_text_that_repeats_itself(spark):
    rng = random.Random(7)
    block = "".join(rng.choice("abcdefg \n") for _ in range(30_000))
    rows = [(1, block * 12), (2, block[:20_000] + "!" + block[5_000:])]
    got = sorted((r["doc_id"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 330_000, 1, block.encode()), (2, 45_000, 2, b"!")]


@pytest.mark.parametrize("depth", [8, 10, 16, 30, 100])
def test_suffix_order_and_classes(depth):
    rng = np.random.default_rng(2)
    shards = [rng.integers(0, 3, n).astype(np.uint8) for n in (50, 7, 120, 33, 64)]
    shards += [np.tile(shards[0], 3), np.concatenate([shards[2], shards[2][:90]])]
    words = [[tuple(np.roll(t, -k)[np.arange(depth) % len(t)]) for k in range(len(t))] for t in shards]
    for t, w in zip(shards, words, strict=True):
        order, edge = S.suffix_order(t, depth)
        assert [w[k] for k in order] == sorted(w)
        assert list(edge) == [n == 0 or w[order[n]] != w[order[n - 1]] for n in range(len(t))]
    for some in (shards, shards[:1], shards[5:]):
        label = S.merged_classes(some, depth)
        flat = [x for t, w in zip(shards, words, strict=True) if any(t is u for u in some) for x in w]
        assert len(set(zip(flat, label.tolist(), strict=True))) == len(set(flat)) == len(set(label.tolist()))


def test_windows_of_small_shards():
    rng = random.Random(3)
    base = ["".join(rng.choice("abé") for _ in range(90)).encode() for _ in range(6)]
    items = []
    for i in range(60):
        b = b"".join(rng.choice(base) for _ in range(3))
        items.append(((i // 2, i % 2), 7, len(b) - S.LENGTH, b))
    seen, want = set(), []
    for (i, n), s, e, b in items:
        for k in range(e + 1):
            if b[k : k + S.LENGTH] in seen:
                want.append((i, n, s + k))
            seen.add(b[k : k + S.LENGTH])
    for shard in (1, 500, 4000, 1 << 20):
        assert sorted(map(tuple, S.repeated_windows(items, shard=shard).T.tolist())) == want


def test_decide_across_batches():
    rng = random.Random(1)
    rows = sorted((rng.randint(0, 6), rng.randint(0, 3), rng.randint(0, 5), rng.randint(0, 3)) for _ in range(60))
    whole = S._batch(*[np.array([r[c] for r in rows], np.int64) for c in range(3)], np.zeros(60, np.int64), np.array([r[3] for r in rows], np.int64), *[np.zeros(60, np.int64)] * 2)
    want = sorted(map(str, (r for b in S._decide(iter([whole])) for r in b.to_pylist())))
    for size in (1, 2, 3, 7, 20):
        got = sorted(map(str, (r for b in S._decide(whole.slice(i, size) for i in range(0, 60, size)) for r in b.to_pylist())))
        assert got == want, size
