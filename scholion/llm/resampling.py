"""Importance resampling towards a target distribution.

Words and pairs of neighbouring words fall into a fixed number of buckets; a bucket's gain says how much more often the
target has it than the corpus. A document weighs the mean gain of its features, and Gumbel noise hashed from its id turns
the largest scores into a sample without replacement, in proportion to the weights.

1. Both texts are counted where they are read: a task hands on one row for a bucket, not for a feature.
2. Gains are one array of numbers, as long as there are buckets whatever the input, which tasks index with whole texts' buckets.
3. The cutoff is found by a quantile sketch: two of its quantiles bracket it, and an exact count of what lies above and inside
   says whether they do; if not, the bracket is widened. Only the bracket is sorted, and its row at the missing
   place is the cutoff.
4. What is drawn is ranked over ranges of (score, id): tasks number their own rows, and add the sizes of the ranges before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.llm.common import Scratch, slices, small_batches, written

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 7, 20, 25
#: How precise the sketch is asked to be, and how far from the wanted place, as a share of all rows, the bracket begins.
ACCURACY, REACH = 2000, 0.002
_STEP = 1 << 20
#: A-Z become a-z, other ASCII characters that are no letter or digit a space.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    start = 0
    while start < len(text):
        end = start + _STEP
        if end < len(text):
            # The first byte beyond that can end a word.
            end = next((k for k in range(end, len(text)) if _PLAIN[text[k]] == 32), len(text))
        if words := text[start:end].translate(_PLAIN).split():
            yield words
        start = end


def features(text: bytes, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """The buckets of a text's features, every word and every two neighbours joined by a space, in arrays of bounded size.
    A checksum goes on where that of the first word and the space ended, so that pairs are never built."""
    last: list[int] = []
    for words in _pieces(text):
        single = list(map(crc32, words))
        before = last + list(map(crc32, repeat(b" "), single))
        pairs = list(map(crc32, words if last else words[1:], before))
        last = before[-1:]
        yield np.array(single + pairs, np.int64) % buckets


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in (part for batch in batches for part in slices(batch, 0)):
            for text in part.column(0):
                for found in features(text.as_py() or b"", buckets):
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([some, total[some]], ["_b", "_c"])

    return run


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. Its length does not depend on the input."""
    texts = df.select(F.col(text_col).cast("binary").alias("_text"))
    with small_batches(df.sparkSession):
        rows = texts.mapInArrow(_counts(buckets), "_b long, _c long").groupBy("_b").agg(F.sum("_c").alias("_c")).collect()
    out = np.zeros(buckets, np.int64)
    for b, c in rows:
        out[b] = c
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's share over the corpus's), each with one feature more in every bucket."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1) * (s + n) / ((x + 1) * (t + n)))) for x, y in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weights(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, 1)):
            count, weight = [], []
            for text in part.column(1):
                n = total = 0
                for found in features(text.as_py() or b"", len(gain)):
                    n, total = n + len(found), total + int(gain[found].sum())
                count.append(n)
                weight.append(total // n if n else 0)
            yield pa.record_batch([part.column(0), pa.array(count, pa.int64()), pa.array(weight, pa.int64())], ["_id", "n_features", "weight"])

    return run


def noise(seed: int, doc_id: Column) -> Column:
    """Gumbel noise in thousandths, from 32 bits of a SHA-256 digest of seed and id (a null id is an empty one)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(df: DataFrame, scratch: Scratch) -> DataFrame:
    """``df`` with ``rank``, from 1 by score descending and id, without a task that sees all rows: rows are dealt and sorted by
    ranges, numbered in their range, and the ranges' sizes, one row a task, are added up."""
    order = (F.desc("score"), F.asc_nulls_last("_id"))
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    own = F.monotonically_increasing_id()
    parts = scratch.written(dealt.withColumn("_part", F.shiftrightunsigned(own, 33)).withColumn("_at", own.bitwiseAND((1 << 33) - 1)), "ranges")
    sizes = sorted(parts.groupBy("_part").count().collect())
    before = np.cumsum([0, *[n for _, n in sizes]]).tolist()
    starts = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "_p long, _start long")
    return parts.join(F.broadcast(starts), F.col("_part") == F.col("_p")).select(*df.columns, (F.col("_start") + F.col("_at") + 1).alias("rank"))


def cutoff(scores: DataFrame, wanted: int, rows: int, scratch: Scratch) -> tuple[int, int | None]:
    """The score and id of the row at place ``wanted`` of ``rows`` rows (score, _id)."""
    reach, low, high = REACH, None, None
    while True:
        at = 1 - wanted / rows
        sketch = [max(0.0, at - reach), min(1.0, at + reach)]
        low, high = scores.agg(F.percentile_approx("score", sketch, ACCURACY)).first()[0]
        # At the ends the bracket is open.
        low, high = (low if sketch[0] > 0 else None), (high if sketch[1] < 1 else None)
        above = F.lit(False) if high is None else F.col("score") > high
        inside = ~above & (F.lit(True) if low is None else F.col("score") >= low)
        over, within = scores.agg(F.count_if(above), F.count_if(inside)).first()
        if over < wanted <= over + within:
            break
        reach = reach * 4 if reach < 1 else 1.0
    row = ranked(scores.filter(inside), scratch).filter(F.col("rank") == wanted - over).first()
    return row["score"], row["_id"]


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_features, weight, score, rank) for each row of ``df``; ``rank`` is null where a row is not drawn.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A null text has no words, and without words
    ``weight`` is 0. Of the rows with ``least_words`` words or more, ``percent`` in a hundred (rounded down) are drawn. Ids are
    integers; a null id hashes as the empty string and comes after others of its score. Rows that repeat an id are rows of their own, with the
    same noise; between rows of one score and id any may come first, and as many are drawn as in any other table. An empty
    table gives no rows, an empty target one without features. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession)
    gain = gains(bucket_counts(df, text_col, buckets), bucket_counts(target, target_col, buckets))
    docs = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    with small_batches(df.sparkSession):
        weighed = docs.mapInArrow(_weights(gain), "_id long, n_features long, weight long")
        scored = written(weighed.withColumn("score", F.col("weight") + noise(seed, F.col("_id"))), "scores")
    named = lambda df, rank: df.select(F.col("_id").alias(id_col), "n_features", "weight", "score", rank.cast("long").alias("rank"))
    # w words have w + (w - 1) features.
    fit = F.col("n_features") >= max(1, 2 * least_words - 1) if least_words else F.lit(True)
    rows = scored.filter(fit).count()
    wanted = percent * rows // 100
    if not wanted:
        return named(scored, F.lit(None))
    score, last = cutoff(scored.filter(fit).select("score", "_id"), wanted, rows, scratch)
    upto = F.lit(True) if last is None else F.coalesce(F.col("_id") <= last, F.lit(False))
    reached = fit & ((F.col("score") > score) | ((F.col("score") == score) & upto))
    drawn = written(ranked(scored.filter(reached), scratch), "drawn")
    scratch.clear()
    # Rows that repeat the cutoff's id may be one too many.
    return named(drawn, F.when(F.col("rank") <= wanted, F.col("rank"))).unionByName(named(scored.filter(~reached), F.lit(None)))
