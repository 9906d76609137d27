"""Leaves of a text are merged together, and give what each of them gives alone."""

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex

from scholion.llm import bpe

TEXT = "Zürich zählt 12345 naïve Cafés, 日本語のテキスト and unbelievably reconfigured words: aaaaaaaaaaaaaaaaaaaaaaaa aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa  x\ty 🎉🎉"


@pytest.fixture(scope="module")
def ranks():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe.parse_ranks(f.read())


def test_leaves_together_are_leaves_alone(ranks):
    rng = np.random.default_rng(5)
    leaves = [m.encode()[: bpe.LEAF] for m in regex.findall(P.PATTERN, TEXT)] + [bytes(rng.choice(list(b"etaoin sh\xc3\xa9"), n % bpe.LEAF + 1)) for n in range(800)]
    alone = bpe.Bpe(ranks)
    assert bpe.Bpe(ranks, bpe.Pairs.of(ranks)).encode_leaves(leaves) == list(map(alone.encode, leaves))
    few = {b"a": 0, b"b": 1, b"ab": 2}  # not every byte is a token
    assert bpe.Pairs.of(few) is None and bpe.Bpe(few).encode_leaves([b"abab", b"ba"]) == [(2, 2), (1, 0)]


def test_texts_share_what_they_have_met(ranks, monkeypatch):
    texts = [TEXT, None, "", TEXT[::-1], TEXT * 3]
    batch = pa.record_batch({"id": pa.array(range(5)), "text": pa.array(texts)})
    want = [[i for m in regex.findall(P.PATTERN, t or "") for i in bpe.Bpe(ranks).encode(m.encode())] for t in texts]
    for cache, part, block in ((bpe.CACHE, bpe.PART, bpe.BLOCK), (10, 300, 4), (1, 1, 1)):
        monkeypatch.setattr(bpe, "CACHE", cache)
        monkeypatch.setattr(bpe, "PART", part)
        monkeypatch.setattr(bpe, "BLOCK", block)
        found = list(bpe._encoded(iter([batch]), ranks, P.PATTERN, bpe.Pairs.of(ranks)))
        assert [ids for b in found for ids in b.column("ids").to_pylist()] == want


def test_decoded_ids(ranks, monkeypatch):
    lists = [[ranks[b" the"], ranks[b"a"]], None, [], [ranks[bytes([b])] for b in range(256)], [0]]
    batch = pa.record_batch({"ids": pa.array(lists, pa.list_(pa.int32()))})
    want = [b" thea", None, b"", bytes(range(256)), next(t for t, r in ranks.items() if r == 0)]
    for most in (bpe.IDS, 3):
        monkeypatch.setattr(bpe, "IDS", most)
        assert [t for b in bpe._decoded(iter([batch]), ranks, 0) for t in b.column("decoded").to_pylist()] == want
    for bad in (-1, max(ranks.values()) + 1, None):
        with pytest.raises(KeyError):
            list(bpe._decoded(iter([pa.record_batch({"ids": pa.array([[0, bad]], pa.list_(pa.int32()))})]), ranks, 0))
