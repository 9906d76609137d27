"""Language identification with a string kernel.

The kernel is a normalised blended spectrum: texts are the sets of the byte n-grams of 1 to 4 bytes
that occur in them, and k(x, y) = |x and y| / sqrt(|x| |y|), over a vocabulary of the n-grams that tell
the languages of the sample apart best. Nyström landmarks, a few sample texts of each language, stand
for the kernel matrix, and one-versus-rest kernel ridge regression on them gives a score for every
language. Learning sees a bounded sample; scoring reads every whole text, in batches that are two
matrix products each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.batches import bounded_batches
from scholion.llm.common import slices, written

#: The bounds of learning: sample texts and landmarks of a language, sample texts in all (many languages share them,
#: each has one at least), n-grams.
SAMPLE, LANDMARKS, TEXTS, GRAMS = 150, 24, 9600, 4096
RIDGE = 1e-3
LONGEST = 4
#: Bytes of a text that are looked at together.
BLOCK = 1 << 17
#: Up to so many labels, one row of bounds for each is sent to every task.
BROADCAST_LABELS = 10_000
_SLOTS = 20


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def codes(text: bytes) -> list[np.ndarray]:
    """For n = 1 to 4, the n-gram at every position as a number."""
    b = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    out = [b]
    for n in range(1, LONGEST):
        out.append((out[-1][:-1] << np.uint32(8)) | b[n:])
    return out


def blocks(text: bytes) -> Iterator[bytes]:
    """A text in pieces that overlap by all but one byte of the longest n-gram, so that none is missed."""
    for start in range(0, max(1, len(text)), BLOCK):
        yield text[start : start + BLOCK + LONGEST - 1]


class Grams:
    """A vocabulary of n-grams, given as n << 32 | code, with look-up by table. Short n-grams are their own slots; the
    others are hashed with a factor for which no two of them share a slot."""

    def __init__(self, keys: list[int]) -> None:
        self.tables: list[tuple[np.ndarray, np.uint32 | None]] = []
        own = [np.array(sorted(k & 0xFFFFFFFF for k in keys if k >> 32 == n), np.uint32) for n in range(1, LONGEST + 1)]
        self.codes, self.size = np.concatenate(own), len(keys)
        start = 0
        for n, code in enumerate(own, 1):
            factor = None if n <= 2 else np.uint32(2654435761)
            while len(np.unique(at := self.slot(code, factor))) < len(code):
                factor = factor + np.uint32(0x3C6EF372)
            index = np.full(1 << (8 * n if n <= 2 else _SLOTS), -1, np.int16)
            index[at] = np.arange(start, start + len(code))
            start += len(code)
            self.tables.append((index, factor))

    @staticmethod
    def slot(code: np.ndarray, factor: np.uint32 | None) -> np.ndarray:
        return code if factor is None else (code * factor) >> np.uint32(32 - _SLOTS)

    def mark(self, text: bytes, row: np.ndarray) -> None:
        """Set what occurs in the text."""
        for block in blocks(text):
            for (index, factor), code in zip(self.tables, codes(block), strict=True):
                hit = index[self.slot(code, factor)]
                some = hit >= 0
                hit = hit[some]
                row[hit if factor is None else hit[self.codes[hit] == code[some]]] = 1


class Model:
    """Landmarks and weights; ``scores`` is the kernel with the landmarks times the weights. Of ``marks``, the sample's
    rows, the ``landmarks`` first of each language are its landmarks."""

    def __init__(self, langs: list[str], keys: list[int], marks: np.ndarray, labels: np.ndarray, landmarks: int = LANDMARKS) -> None:
        self.langs, self.keys = langs, keys
        at = np.concatenate([np.flatnonzero(labels == n)[:landmarks] for n in range(len(langs))])
        self.rows = self.unit(marks[at])
        k = self.unit(marks) @ self.rows.T
        y = np.where(labels[:, None] == np.arange(len(langs))[None, :], 1.0, -1.0)
        left = k.T.astype(np.float64) @ k + RIDGE * len(k) * k[at] + 1e-8 * np.eye(len(at))
        self.weights = np.linalg.solve(left, k.T @ y).astype(np.float32)

    @staticmethod
    def unit(marks: np.ndarray) -> np.ndarray:
        return marks.astype(np.float32) / np.sqrt(np.maximum(1, marks.sum(1, dtype=np.int64)))[:, None].astype(np.float32)

    def scores(self, marks: np.ndarray) -> np.ndarray:
        return (self.unit(marks) @ self.rows.T) @ self.weights


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            found: list[np.ndarray] = [np.zeros(0, np.int64)]
            for block in blocks(text.as_py().encode()):
                found = [np.unique(np.concatenate([*found, *(np.unique(c).astype(np.int64) + ((n + 1) << 32) for n, c in enumerate(codes(block)))]))]
            yield pa.record_batch({"_lang": pa.array([lang.as_py()] * len(found[0]), pa.string()), "_gram": found[0]})


def sample_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(_lang, _n, _text): of each language the rows with the smallest hashed ids, numbered from 1. A first pass over ids
    finds the hash up to which rows may count, so that texts move only for the sample; rows that repeat an id are
    told apart by the hash of their text and counted one by one, so its size never depends on them."""
    known = df.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.select(F.col(lang_col).alias("_lang"), F.xxhash64(id_col).alias("_h"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    langs = known.select("_lang").distinct().count()
    each = max(1, min(SAMPLE, TEXTS // max(1, langs)))
    number = lambda *order: F.row_number().over(Window.partitionBy("_lang").orderBy("_h", *order))
    bounds = known.select("_lang", "_h").withColumn("_n", number()).filter(F.col("_n") <= each).groupBy("_lang").agg(F.max("_h").alias("_most"))
    bounds = bounds.withColumnRenamed("_lang", "_l")
    near = known.join(F.broadcast(bounds) if langs <= BROADCAST_LABELS else bounds, (F.col("_lang") == F.col("_l")) & (F.col("_h") <= F.col("_most")))
    return near.withColumn("_n", number("_id", F.xxhash64("_text"), "_text")).filter(F.col("_n") <= each).select("_lang", "_n", "_text")


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of ``df``'s rows with text and language; None if there are none. It reads ``sample_of`` them, as whole
    texts; what comes to the driver is 4,096 n-grams and, for each sample text, which of those occur in it. Landmarks
    are the first texts of each language by hashed id."""
    bounded_batches(df.sparkSession)
    sample = written(sample_of(df, id_col, text_col, lang_col), "sample")
    per = sample.groupBy("_lang").agg(F.count(F.lit(1)).alias("_of"))
    of = {r["_lang"]: r["_of"] for r in per.collect()}
    if not of:
        return None
    langs = sorted(of)
    shares = sample.select("_lang", "_text").mapInArrow(_gram_counts, "_lang string, _gram long").groupBy("_lang", "_gram").agg(F.count(F.lit(1)).alias("_n")).join(per, "_lang")
    spread = shares.groupBy("_gram").agg((F.max(F.col("_n") / F.col("_of")) - F.when(F.count(F.lit(1)) < len(langs), 0.0).otherwise(F.min(F.col("_n") / F.col("_of")))).alias("_s"))
    keys = [r["_gram"] for r in spread.orderBy(F.desc("_s"), "_gram").limit(GRAMS).collect()]
    bits = sample.select("_lang", "_n", "_text").mapInArrow(lambda batches: _marked(batches, keys), "_lang string, _n int, _bits binary").collect()
    bits.sort(key=lambda r: (r["_lang"], r["_n"]))
    marks = np.array([np.unpackbits(np.frombuffer(r["_bits"], np.uint8), count=len(keys)) for r in bits])
    return Model(langs, keys, marks, np.array([langs.index(r["_lang"]) for r in bits]), max(1, min(LANDMARKS, TEXTS * LANDMARKS // (SAMPLE * len(langs)))))


def _marked(batches: Iterator[pa.RecordBatch], keys: list[int]) -> Iterator[pa.RecordBatch]:
    grams = Grams(keys)
    for batch in batches:
        rows = np.zeros((batch.num_rows, grams.size), np.uint8)
        for row, text in zip(rows, batch.column(2), strict=True):
            grams.mark(text.as_py().encode(), row)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([np.packbits(r).tobytes() for r in rows], pa.binary())], ["_lang", "_n", "_bits"])


def answers(keep: list[str]) -> list[str]:
    """The names of the new columns beside those that are kept: lang_pred, score and held_out, with underscores after them where
    a kept column has the name."""
    out = []
    for name in ("lang_pred", "score", "held_out"):
        while name in keep:
            name += "_"
        out.append(name)
    return out


def predict(df: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """(*keep, lang_pred, score) for each row of ``df``, the new names as ``answers`` gives them.
    ``lang_pred`` is ``und`` with score 0 if the text is null or has no letter, or if there is no model. ``score`` is
    the best ridge score moved from [-1, 1] to [0, 1]. Every row is judged by its own text, so repeated rows get the
    same answer; no row moves."""
    bounded_batches(df.sparkSession)
    lang_name, score_name, _ = answers(keep)
    has_letter = F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return df.select(*[F.col(f"`{c}`") for c in keep], F.lit("und").alias(lang_name), F.lit(0.0).alias(score_name))
    named = keep if text_col in keep else [*keep, text_col]
    at, kinds = named.index(text_col), dict(df.dtypes)
    own = [f"c{n}" for n in range(len(keep))]  # names of the rows on their way, whatever the columns are called

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(model.keys)
        for part in (part for batch in batches for part in slices(batch, at, 2 << 20, 256)):
            marks = np.zeros((part.num_rows, grams.size), np.uint8)
            told = part.column(len(named)).to_numpy(zero_copy_only=False)
            for row, text, fine in zip(marks, part.column(at), told, strict=True):
                if fine:
                    grams.mark(text.as_py().encode(), row)
            scores = model.scores(marks)
            best = scores.argmax(1)
            top = np.clip((scores[np.arange(len(best)), best] + 1) / 2, 0, 1).astype(np.float64)
            lang = pa.array([model.langs[b] if fine else "und" for b, fine in zip(best, told, strict=True)], pa.string())
            yield pa.record_batch([*part.columns[: len(keep)], lang, pa.array(np.where(told, top, 0.0))], [*own, "lang", "score"])

    rows = df.select(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(named)], has_letter.alias("letter"))
    out = rows.mapInArrow(run, ", ".join([*(f"{o} {kinds[c]}" for o, c in zip(own, keep, strict=True)), "lang string", "score double"]))
    return out.select(*[F.col(o).alias(c) for o, c in zip(own, keep, strict=True)], F.col("lang").alias(lang_name), F.col("score").alias(score_name))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """``predict`` on all of ``df`` with the model of its rows that are not held out, and ``held_out``. ``keep`` names
    the columns to carry besides the answers, by default the id alone; the id must be among them."""
    learn = df.filter(~F.coalesce(held_out(F.col(id_col)), F.lit(True)))
    keep = keep or [id_col]
    out = predict(df, fit(learn, id_col, text_col, lang_col), keep, text_col)
    return out.withColumn(answers(keep)[2], F.coalesce(held_out(F.col(id_col)), F.lit(False)))
