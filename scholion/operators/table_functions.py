"""Table functions for SQL: the tokens, sentences, sections and chunks of a text, by lateral joins.

    SELECT doc_id, t.* FROM documents, LATERAL text_tokens(text) AS t
    SELECT doc_id, s.* FROM documents, LATERAL text_sections(text) AS s
    SELECT doc_id, c.* FROM documents, LATERAL text_chunks(text, 1000, 150) AS c

Tokens, sentences and the units of chunks are SQL functions, which Catalyst puts in place, so they stay in the JVM and need no shuffle.
Sections and the packing of units are Python table functions, a text at a time; units go there a hundred texts at a time, as an Arrow
batch of them would hold thousands of lists. A null text has no rows in any of them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from scholion.functions.text import SPACE, STOP_WORDS, TOKEN
from scholion.operators.chunks import LEAST_CHARS, pack
from scholion.operators.sections import cut

TRIM = rf"^{SPACE}+|{SPACE}+$"


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replaced(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(by)})"


def _filled(array: str, name: str) -> str:
    """Its entries trimmed, without empty ones."""
    return f"filter(transform({array}, {name} -> {_replaced(name, TRIM)}), {name} -> {name} <> '')"


def _tokens(text: str) -> str:
    stops = ", ".join(map(_quoted, STOP_WORDS))
    return f"filter(regexp_extract_all(lower(coalesce({text}, '')), {_quoted(TOKEN)}, 0), t -> t NOT IN ({stops}) AND (length(t) > 1 OR t >= '぀'))"


def _sentences(text: str, name: str = "s") -> str:
    marked = _replaced(_replaced(_replaced(f"coalesce({text}, '')", rf"([.!?。！？]){SPACE}+", "$1\x01"), "([。！？])", "$1\x01"), r"\n{2,}", "\x01")
    return _filled(f"split({marked}, '\x01')", name)


def _split(pieces: str, name: str, smaller: str) -> str:
    """Its entries, those over the size in smaller ones."""
    return f"flatten(transform({pieces}, {name} -> if(length({name}) <= size, array({name}), {smaller})))"


def _units(text: str) -> str:
    whole = _replaced(f"coalesce({text}, '')", TRIM)
    words = f"flatten(transform(split(l, {_quoted(SPACE + '+')}), w -> regexp_extract_all(w, concat('(?s).{{1,', size, '}}'), 0)))"
    lines = _split(_filled(f"split(s, {_quoted(chr(92) + 'n')})", "l"), "l", words)
    paragraphs = _split(_filled(f"split({whole}, {_quoted(chr(92) + 'n' + chr(92) + 'n')})", "p"), "p", _split(_sentences("p"), "s", lines))
    return f"CASE WHEN {whole} = '' THEN cast(array() AS array<string>) WHEN length({whole}) <= size THEN array({whole}) ELSE {paragraphs} END"


class _Sections:
    def eval(self, text: str) -> Iterator[tuple]:
        yield from cut(text or "")


class _Chunks:
    def eval(self, units: list, size: int, overlap: int) -> Iterator[tuple]:
        if overlap >= size:
            raise ValueError("the overlap must be smaller than the size")
        kept = (c for c in pack(list(units) if units is not None else [], size, overlap) if len(c) >= LEAST_CHARS)
        for n, content in enumerate(kept):
            yield n, content, len(content)


def register(spark: SparkSession) -> None:
    """Makes ``text_tokens(text)``, ``text_sentences(text)``, ``text_sections(text)`` and ``text_chunks(text, size, overlap)`` known to the
    session, for use in a FROM clause."""
    define = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(f"{define} text_tokens(text STRING) RETURNS TABLE (pos INT, token STRING) RETURN SELECT pos, col FROM posexplode({_tokens('text')})")
    spark.sql(f"{define} text_sentences(text STRING) RETURNS TABLE (pos INT, sentence STRING) RETURN SELECT pos, col FROM posexplode({_sentences('text')})")
    chunk = "chunk_index BIGINT, content STRING, char_count BIGINT"
    spark.udtf.register("text_sections", udtf(_Sections, returnType="section_seq bigint, section string, content string", useArrow=True))
    spark.udtf.register("packed_units", udtf(_Chunks, returnType=chunk, useArrow=False))
    spark.sql(f"{define} text_chunks(text STRING, size INT, overlap INT) RETURNS TABLE ({chunk}) RETURN SELECT * FROM packed_units({_units('text')}, size, overlap)")
