"""Words and labels as Column expressions: stems, keyword tokens, slugs, options, answers, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholion.functions.text import SPACE, tokens

#: Answers that mean true and false, file types, and the legacy types that are refused.
TRUE = ["true", "t", "yes", "correct", "对", "正确", "是"]
FALSE = ["false", "f", "no", "incorrect", "错", "错误", "否"]
TYPES = ["pdf", "pptx", "docx", "md", "markdown", "txt"]
LEGACY = ["ppt", "doc"]
KANA = "぀"


#: Fixed values, the endings of the stemmer: plurals that lose two letters, endings in s that stay, verb endings, the bases
#: that get an e back, and the doubled letters that stay double.
TWO_LESS, KEPT, VERBS, WITH_E, DOUBLE = ("sses", "ches", "shes", "xes"), ("ss", "us", "is"), ("ing", "ed"), ("at", "iz", "bl", "uc", "v"), ("l", "s", "z")


def _ends(word: Column, endings: tuple[str, ...]) -> Column:
    found = word.endswith(endings[0])
    for e in endings[1:]:
        found = found | word.endswith(e)
    return found


def stem(word: Column) -> Column:
    """A word of four ASCII letters or more without its plural or verb ending."""
    shorter = lambda x, n: F.substring(x, F.lit(1), F.length(x) - n)
    base = F.regexp_replace(word, f"({'|'.join(VERBS)})$", "")
    last = F.right(base, F.lit(1))
    verb = F.when(_ends(base, WITH_E), F.concat(base, F.lit("e"))).when((last == F.substring(base, -2, 1)) & ~last.isin(*DOUBLE), shorter(base, 1)).otherwise(base)
    plural = F.when(word.endswith("ies") & (F.length(word) > 4), F.concat(shorter(word, 3), F.lit("y"))).when(_ends(word, TWO_LESS), shorter(word, 2)).when(_ends(word, KEPT), word).otherwise(shorter(word, 1))
    # Most words end otherwise, and need no pattern.
    return F.when(~_ends(word, ("s", *VERBS)) | ~word.rlike("^[a-z]{4,}$"), word).when(word.endswith("s"), plural).when(F.length(base) >= 3, verb).otherwise(word)


def stem_word(word: str) -> str:
    """``stem`` of one word, for passes over Arrow batches that remember words they have met."""
    if not word.endswith(("s", *VERBS)) or len(word) < 4 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith("s"):
        if word.endswith("ies") and len(word) > 4:
            return word[:-3] + "y"
        return word[:-2] if word.endswith(TWO_LESS) else word if word.endswith(KEPT) else word[:-1]
    base = word.removesuffix("ing") if word.endswith("ing") else word.removesuffix("ed")
    if len(base) < 3:
        return word
    if base.endswith(WITH_E):
        return base + "e"
    return base[:-1] if base[-1] == base[-2] and base[-1] not in DOUBLE else base


def stems(text: Column) -> Column:
    return F.transform(tokens(text), stem)


def with_pairs(words: Column) -> Column:
    """Words, then the pairs of neighbouring CJK characters among them. Give it a column that is computed already."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.when((a >= KANA) & (b >= KANA), F.concat(a, b)))
    return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))


def keyword_tokens(text: Column) -> Column:
    """Stems, then the pairs of neighbouring CJK characters among them."""
    return with_pairs(stems(text))


def slug(text: Column) -> Column:
    """Lower case, words joined by hyphens, at most 60 characters; ``untitled`` when nothing is left."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_ \t\n\r\f-]+", "")
    joined = F.regexp_replace(F.regexp_replace(kept, rf"[ \t\n\r\f_-]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(F.left(joined, F.lit(60)), F.lit("")), F.lit("untitled"))


def clean_option(text: Column) -> Column:
    """An option without a prefix such as ``A) ``, ``(b). `` or ``C - ``."""
    bare = F.regexp_replace(text, rf"^{SPACE}*(\(?[A-Da-d][).:]|[A-Da-d]{SPACE}*[-–]){SPACE}+", "")
    return F.regexp_replace(bare, rf"^{SPACE}+|{SPACE}+$", "")


def truth(text: Column) -> Column:
    """``True`` or ``False`` for a synonym of either, else null."""
    key = F.regexp_replace(F.lower(F.trim(text)), r"\.+$", "")
    return F.when(key.isin(TRUE), "True").when(key.isin(FALSE), "False")


def canonical_email(value: Column) -> Column:
    return F.lower(F.trim(value))


def safe_filename(name: Column) -> Column:
    """The last component of a path, trimmed, at most 255 characters; ``upload`` when empty."""
    last = F.trim(F.substring_index(F.regexp_replace(F.coalesce(name, F.lit("")), "/+$", ""), "/", -1))
    return F.left(F.coalesce(F.nullif(last, F.lit("")), F.lit("upload")), F.lit(255))


def file_type(name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1))
    return F.when(suffix == "markdown", "md").otherwise(suffix)


def location(page: Column, slide: Column, section: Column) -> Column:
    """``slide n``, else ``page n``, else the section."""
    return F.coalesce(F.concat(F.lit("slide "), slide), F.concat(F.lit("page "), page), section)


def embedding_text(title: Column, section: Column, content: Column) -> Column:
    """The content under a line of its title and section."""
    return F.concat(F.concat_ws(" — ", title, F.nullif(section, F.lit(""))), F.lit("\n"), content)


def word_position(text: Column, term: Column) -> Column:
    """Where ``term`` first stands in ``text`` with no letter, digit or underscore beside it, ASCII case aside, counted from 1; null if
    it does not, or if either is null or the term empty."""
    literal = F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    before = F.regexp_substr(text, F.concat(F.lit(r"(?is)^.*?(?="), literal, F.lit(r")(?<![\p{L}\p{N}_])"), literal, F.lit(r"(?![\p{L}\p{N}_])")))
    return F.when(term != "", F.length(before) - F.length(term) + 1)


def holds_word(text: Column, term: Column) -> Column:
    """Whether ``term`` stands in ``text`` as ``word_position`` says."""
    return word_position(text, term).isNotNull()
