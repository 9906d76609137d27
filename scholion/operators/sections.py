"""Sections of Markdown, limits on what a document holds, summaries, and questions from definitions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.functions.text import SPACE, truncate
from scholion.operators.terms import candidates, good_sentence

HEADING = r"^(#{1,6})[ \t]+(.*?)[ \t#]*$"


_HEADING, _FENCE, _BLANK = re.compile(HEADING), re.compile(r"[ \t]*(```|~~~)"), " \t\n\r\f"


def cut(text: str) -> Iterator[tuple[int, str | None, str]]:
    """(seq, section, content) of a text cut before its headings, outside code fences; parts without content are left out."""
    seq, fenced, section, body = 0, False, None, []
    open_: dict[int, str] = {}
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
        found = None if fenced else _HEADING.match(line)
        if found:
            if content := "\n".join(body).strip(_BLANK):
                yield seq, section, content
            level, body = len(found[1]), []
            # A heading closes those of its level and below.
            open_ = {k: name for k, name in open_.items() if k < level} | {level: found[2]}
            below = [name for k, name in open_.items() if k > 1 and name]
            section = " › ".join(below[-2:]) if below else open_.get(1) or None
            section, seq = section and section[:300], seq + 1
        body.append(line)
    if content := "\n".join(body).strip(_BLANK):
        yield seq, section, content


def markdown_sections(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, section_seq, section, content): a text cut before its headings, outside code fences.

    ``section`` joins the last two headings below the top level that are open, or is the top one; null before any
    heading. ``content`` holds the heading's line too and is trimmed; sections without content are left out. A text is cut where it
    is read, in one pass over its lines; a null text has no sections, and rows that repeat an id are cut each.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                rows = list(cut(batch.column(1)[n].as_py() or ""))
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
                    yield pa.record_batch([pa.repeat(batch.column(0)[n], len(rows)), *columns], [id_col, "section_seq", "section", "content"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, section_seq bigint, section string, content string")


def content_limits(pages: DataFrame, doc: str, text: str, most_pages: int, most_chars: int) -> DataFrame:
    """(doc, pages, chars, error_code): what each document holds, and ``too_many_pages``, ``no_text`` or ``too_long``. Blank pages count as pages only."""
    filled = F.when(F.col(text).rlike(r"[^ \t\n\r\f]"), F.length(text)).otherwise(0)
    held = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.coalesce(filled, F.lit(0))).alias("chars"))
    return held.withColumn("error_code", F.when(F.col("pages") > most_pages, "too_many_pages").when(F.col("chars") == 0, "no_text").when(F.col("chars") > most_chars, "too_long"))


def summary(text: Column) -> Column:
    """A text's first two good sentences, at most 280 characters; empty without any."""
    return truncate(F.array_join(F.slice(F.filter(candidates(text), good_sentence), 1, 2), " "), 280)


def definition_choices(defined: DataFrame, pools: DataFrame, scope: str, id_col: str = "doc_id", wrong: int = 3) -> DataFrame:
    """(id, term, definition, options): a choice question of each definition.

    ``defined`` holds (scope, id, term, definition), ``pools`` (scope, term) the few key terms of a scope. Wrong options are
    other terms of the pool that neither hold the right one, nor are held by it or the definition; which ones, and the order of
    all, follows from a digest of the ids. Definitions without ``wrong`` of them have no question.
    """
    pool = pools.groupBy(F.col(scope).alias("_scope")).agg(F.collect_set("term").alias("_pool"))
    asked = defined.join(pool, F.col(scope) == F.col("_scope"))
    low = F.lower("term")
    other = F.filter("_pool", lambda t: ~F.contains(low, t) & ~F.contains(t, low) & ~F.contains(F.lower(F.col("definition")), t))
    dealt = lambda a: F.transform(F.array_sort(F.transform(a, lambda t: F.concat(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(":"), low, F.lit(":"), t)), t))), lambda s: F.substring(s, F.lit(33), F.length(s)))
    asked = asked.withColumn("_wrong", F.slice(dealt(other), 1, wrong)).filter(F.size("_wrong") == wrong)
    return asked.select(id_col, "term", "definition", dealt(F.concat("_wrong", F.array(low))).alias("options"))
