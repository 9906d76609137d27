"""Chunks: text in units of paragraphs, sentences, lines or words, packed to a size with an overlap.

Units come from column functions. The packing looks back at what it has packed, so a fold of columns would copy
its state for every unit of a long text; it is a short loop over Arrow batches instead, linear in the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.functions.batches import slices
from scholion.functions.text import SPACE, sentences

LEAST_CHARS = 20
#: Units of texts that a task packs at once, a text at least.
UNITS = 4096


def _trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, rf"^{SPACE}+|{SPACE}+$", "")), lambda p: p != "")


def units(text: Column, size: int) -> Column:
    """Pieces of a text, in order, as large as ``size`` allows: itself, paragraphs, sentences, lines, words, and
    stretches of ``size`` characters of longer words."""
    fits = lambda x: F.length(x) <= size
    words = lambda x: F.flatten(F.transform(F.split(x, rf"{SPACE}+"), lambda w: F.regexp_extract_all(w, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))))
    lines = lambda x: F.flatten(F.transform(_trimmed(F.split(x, "\n")), lambda y: F.when(fits(y), F.array(y)).otherwise(words(y))))
    said = lambda x: F.flatten(F.transform(sentences(x), lambda y: F.when(fits(y), F.array(y)).otherwise(lines(y))))
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}+|{SPACE}+$", "")
    paragraphs = F.flatten(F.transform(_trimmed(F.split(whole, "\n\n")), lambda y: F.when(fits(y), F.array(y)).otherwise(said(y))))
    return F.when(whole == "", F.array().cast("array<string>")).when(fits(whole), F.array(whole)).otherwise(paragraphs)


def pack(parts: list[str], size: int, overlap: int) -> list[str]:
    """Chunks of at most ``size`` characters where the overlap allows it; each but the first starts with the
    last whole parts of the one before, up to ``overlap`` characters."""
    out: list[str] = []
    first = at = 0  # the open chunk is parts[first:at]
    length = 0
    for at, part in enumerate(parts):
        if at > first and length + 1 + len(part) > size:
            out.append("\n".join(parts[first:at]))
            start, length = at, 0
            while start > first and length + len(parts[start - 1]) + (start < at) <= overlap:
                start -= 1
                length += len(parts[start]) + (start + 1 < at)
            first = start
        length += len(part) + (at > first)
    return [*out, "\n".join(parts[first:])] if parts else out


def _pack(size: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch, 1, UNITS)):
            chunks = [[c for c in pack(p, size, overlap) if len(c) >= LEAST_CHARS] for p in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(chunks, pa.list_(pa.string()))], ["_id", "_chunks"])

    return run


def chunk(docs: DataFrame, size: int = 1000, overlap: int = 150, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, chunk_index, content, char_count): chunks of 20 characters or more, numbered from 0 in each text. No
    shuffle: a text's chunks are made where it is read. Null and blank texts have none."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")
    kind = docs.schema[id_col].dataType.simpleString()
    parts = docs.select(F.col(id_col).alias("_id"), units(F.col(text), size).alias("_units"))
    made = parts.mapInArrow(_pack(size, overlap), f"_id {kind}, _chunks array<string>")
    return made.select(F.col("_id").alias(id_col), F.posexplode("_chunks").alias("chunk_index", "content")).withColumn("chunk_index", F.col("chunk_index").cast("long")).withColumn("char_count", F.length("content").cast("long"))
