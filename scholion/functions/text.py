"""Text as Column expressions: tokens, sentences, cleaning, truncation. All stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A word with an optional apostrophe part, or one CJK character.
TOKEN = r"[a-z0-9]+(?:'[a-z]+)?|[぀-ヿ㐀-䶿一-鿿]"
SPACE = r"[ \t\n\r\f]"
#: Words that carry no meaning of their own.
STOP_WORDS = """
a about above after again against all am an and any are aren't as at be because been before being below
between both but by can can't cannot could couldn't did didn't do does doesn't doing don't down during each
few for from further had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself
him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't
my myself no nor not of off on once only or other ought our ours ourselves out over own same shan't she she'd
she'll she's should shouldn't so some such than that that's the their theirs them themselves then there there's
these they they'd they'll they're they've this those through to too under until up very was wasn't we we'd
we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's with
won't would wouldn't you you'd you'll you're you've your yours yourself yourselves also may might must shall
will one two use used using via e.g i.e etc however thus therefore within without per
explain describe define definition question answer tell give show example examples please
""".split()


def tokens(text: Column, keep_stop_words: bool = False) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    if keep_stop_words:
        return found
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS) & ((F.length(t) > 1) | (t >= "぀")))


def bigrams(words: Column) -> Column:
    """Neighbouring words joined by an underscore."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit("_"), b))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """The parts of a text after . ! ? and white space, after each CJK stop, and at empty lines."""
    marked = F.coalesce(text, F.lit(""))
    for pattern, by in ((rf"([.!?。！？]){SPACE}+", "$1\x01"), (r"([。！？])", "$1\x01"), (r"\n{2,}", "\x01")):
        marked = F.regexp_replace(marked, pattern, by)
    trimmed = F.transform(F.split(marked, "\x01"), lambda s: F.regexp_replace(s, rf"^{SPACE}+|{SPACE}+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def clean_whitespace(text: Column) -> Column:
    """One kind of line end, no non-breaking spaces, words whole again that a line break had hyphenated,
    single blanks, and at most one empty line."""
    for pattern, by in ((r"\r\n?", "\n"), ("\u00a0", " "), (r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2"), (r"[ \t\f\x0B]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, by)
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def truncate(text: Column, limit: int) -> Column:
    """Cut at a word's end, with an ellipsis; white space collapses first."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), rf"{SPACE}+", " "), "^ | $", "")
    cut = F.regexp_replace(F.regexp_replace(F.substring(flat, 1, limit), r" [^ ]*$", ""), "[,.;: ]+$", "")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(cut, F.lit("…")))


def first_line_heading(text: Column) -> Column:
    line = F.regexp_replace(F.substring_index(text, "\n", 1), f"^{SPACE}+|{SPACE}+$", "")
    return F.when(F.length(line).between(3, 90) & ~line.rlike("[.,;]$"), line)


def origin(url: Column) -> Column:
    """Scheme and host in lower case, with the port unless it is the scheme's own."""
    scheme, host, port = (F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::(\d+))?", n) for n in (1, 2, 3))
    scheme = F.lower(scheme)
    own = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), F.lower(host), F.when(own, "").otherwise(F.concat(F.lit(":"), port))))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalized(text: Column) -> Column:
    """Compatibility forms of characters as plain ones, in lower case; ASCII texts need no Python."""
    ascii_text = F.when(F.length(text) == F.octet_length(text), text)
    return F.lower(F.coalesce(ascii_text, _nfkc(F.when(F.length(text) != F.octet_length(text), text))))
