"""Sizes, ages and intervals for people; escaping; objects in prose; links to citations; term lists."""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scholion.functions.text import SPACE


#: Texts that are re-flowed at once.
TEXTS = 128


def _nearest(x: Column, digits: int = 0) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def _short(x: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f", _nearest(x, digits).cast("double"))


def human_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(_short(n / 1024), F.lit(" KB"))).otherwise(F.concat(_short(n / (1 << 20), 1), F.lit(" MB")))


#: Up to how many seconds, minutes, hours and days an age is told in the unit before, and days an interval.
MOMENT, HOUR, DAY, MONTH, YEAR = 45, 60, 24, 30, 365


def human_age(seconds: Column, day: Column) -> Column:
    """How long ago, up to 30 days; then the day itself."""
    minutes = _nearest(seconds / 60)
    hours = _nearest(minutes / HOUR)
    days = _nearest(hours / DAY)
    said = lambda x, unit: F.concat(x.cast("long").cast("string"), F.lit(f"{unit} ago"))
    return F.when(seconds < MOMENT, "just now").when(minutes < HOUR, said(minutes, "m")).when(hours < DAY, said(hours, "h")).when(days < MONTH, said(days, "d")).otherwise(day)


def human_interval(days: Column) -> Column:
    said = lambda x, unit: F.concat(_nearest(x).cast("long").cast("string"), F.lit(unit))
    return (
        F.when(days < 1 / DAY, F.concat(F.greatest(F.lit(1), _nearest(days * 1440).cast("long")).cast("string"), F.lit("m")))
        .when(days < 1, said(days * DAY, "h")).when(days < MONTH, said(days, "d")).when(days < YEAR, said(days / MONTH, "mo")).otherwise(F.concat(_short(days / YEAR, 1), F.lit("y")))
    )


def xml_text(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def xml_attribute(text: Column) -> Column:
    """A quoted attribute value: line breaks and tabs as references, and single quotes around what holds double ones only."""
    safe = xml_text(text)
    for raw, ref in (("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        safe = F.replace(safe, F.lit(raw), F.lit(ref))
    double, single = F.contains(safe, F.lit('"')), F.contains(safe, F.lit("'"))
    return F.when(double & ~single, F.concat(F.lit("'"), safe, F.lit("'"))).otherwise(F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit("&quot;")), F.lit('"')))


def json_object(text: Column) -> Column:
    """The JSON object in a text that may wrap it in a fence or in prose, as text; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", ""), rf"(?m)^```(?:json)?{SPACE}*|{SPACE}*```$", "")
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    fine = lambda x: F.when(x.startswith("{") & F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(fine(bare), fine(inner))


def linked_citations(markdown: Column, sources: Column) -> Column:
    """``[1, 2]`` as links to its sources where all of them exist, but not in fenced code and not before a bracket that
    makes it a link already."""
    token = r"(?s)```.*?```|\[\d+(?:[ \t\n\r\f]*[,，][ \t\n\r\f]*\d+)*\]\(?|[^\[`]+|."
    numbers = lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("int"))
    link = lambda x: F.array_join(F.transform(numbers(x), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("](#cite-"), n.cast("string"), F.lit(")"))), "")
    cited = lambda x: x.rlike(r"^\[\d") & x.endswith("]") & F.forall(numbers(x), lambda n: F.coalesce(n.between(1, sources), F.lit(False)))
    return F.array_join(F.transform(F.regexp_extract_all(markdown, F.lit(token), F.lit(0)), lambda x: F.when(cited(x), link(x)).otherwise(x)), "")


def term_frequencies(entries: Column) -> Column:
    """(term, tf) of a text of entries such as ``'tree':1,5 'river':2``; quotes in terms are doubled."""
    entry = r"'((?:[^']|'')*)':([0-9,A-D]+)"
    pairs = F.arrays_zip(F.regexp_extract_all(entries, F.lit(entry), F.lit(1)).alias("t"), F.regexp_extract_all(entries, F.lit(entry), F.lit(2)).alias("p"))
    return F.transform(pairs, lambda x: F.struct(F.replace(x["t"], F.lit("''"), F.lit("'")).alias("term"), F.size(F.split(x["p"], ",")).cast("long").alias("tf")))


def document_title(name: Column) -> Column:
    """A file's name without its suffix, underscores as blanks."""
    return F.translate(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "_", " ")


#: What begins an item of a list, marks that end a clause in the middle and those that end a statement, and from
#: how many characters on a line without the latter is a broken one.
ITEM, MIDDLE, END, LONG = r"(?:[-•*▪●◦]|\d+[.)]|[a-z][.)])[^\S\n]", r",;(\-–/", ".!?:。！？：", 61
_TIED = regex.compile(rf"(?:(?<=[^\n])\n(?=\p{{Lowercase}})|(?<=[{MIDDLE}])\n(?=[^\n]))(?!{ITEM})")
_BROKEN = regex.compile(rf"(?m)^(?=[^\n]{{{LONG}}})[^\n]*(?:(?<![{END}])\n(?!{ITEM})[^\n]+)+")


def _joined(text: str) -> str:
    """Two passes of patterns: line ends whose neighbours alone say that the line goes on, then runs of lines that begin with a
    long one, in which every line end without an end mark goes."""
    lines = "\n".join(map(str.strip, text.split("\n")))
    return _BROKEN.sub(lambda run: run[0].replace("\n", " "), _TIED.sub(" ", lines))


@F.arrow_udf(StringType())
def reflow(texts: pa.Array) -> pa.Array:
    """Lines that a page's width broke, joined: a line goes on if the next one starts in lower case, if it ends in the middle
    of a clause, or if it is long, as joined so far, and has no end mark; items of lists start anew."""
    # A few texts at a time are Python's; the others stay in the batch.
    parts = [pa.array([None if t is None else _joined(t) for t in texts.slice(at, TEXTS).to_pylist()], pa.string()) for at in range(0, len(texts), TEXTS)]
    return pa.concat_arrays(parts) if parts else texts
