"""Questions and cards made from texts: blanks, true or false, short answers, mixes of them; and checks of generated items.

Every choice that a generator would draw at random follows from a digest of ids and terms, so that results are the same on
every run. A sentence gets one term and a term one sentence of a scope: the best ranked term of each sentence, then of its
sentences the one with the smallest digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.text import SPACE, first_line_heading
from scholion.functions.words import clean_option, stem, truth
from scholion.operators.search import sized
from scholion.operators.sections import summary
from scholion.operators.terms import candidates, good_sentence

#: A sentence in pieces: words that can be terms, and single characters.
WORD = r"[A-Za-z][A-Za-z\-]{3,}"
PIECE = rf"{WORD}|(?s)."
BLANK = "_____"


def display(term: Column) -> Column:
    """An acronym as it is, other terms in lower case."""
    return F.when((term == F.upper(term)) & (term != F.lower(term)), term).otherwise(F.lower(term))


def _digest(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def term_sentences(docs: DataFrame, terms: DataFrame, scope: str, id_col: str = "doc_id", text: str = "text", ranks: int = 60) -> DataFrame:
    """(scope, id, pos, term, at, pieces, line): good sentences with the term of theirs, each term of a scope once.
    ``terms`` are (scope, rank, term), few for a scope, which sentences meet as one array; only the sentences that are
    left are cut into pieces."""
    lines = docs.select(scope, id_col, F.posexplode(candidates(F.col(text))).alias("pos", "line")).filter(good_sentence(F.col("line")))
    ranked = F.array_sort(F.collect_list(F.struct(F.col("rank"), F.col("term"))))
    known = terms.filter(F.col("rank") <= ranks).groupBy(F.col(scope).alias("_scope")).agg(ranked.alias("_k")).select("_scope", "_k.term", F.col("_k.rank").alias("_ranks")).withColumnRenamed("term", "_terms")
    words = F.transform(F.regexp_extract_all("line", F.lit(WORD), F.lit(0)), F.lower)
    met = lines.join(sized(known), F.col(scope).eqNullSafe(F.col("_scope")))
    # The intersection keeps the order of the terms, so the first of it has the best rank; a generator computes it once.
    met = met.select(scope, id_col, "pos", "line", "_terms", "_ranks", F.explode(F.slice(F.array_intersect("_terms", words), 1, 1)).alias("term"))
    met = met.withColumn("_rank", F.get("_ranks", (F.array_position("_terms", F.col("term")) - 1).cast("int")))
    best = met.groupBy(scope, id_col, "pos").agg(F.min(F.struct("_rank", "term", "line")).alias("b")).select(scope, id_col, "pos", "b.term", "b.line")
    own = best.groupBy(scope, "term").agg(F.min(F.struct(_digest(id_col, "pos").alias("_d"), F.col(id_col), F.col("pos"), F.col("line"))).alias("b"))
    own = own.select(scope, "term", *[F.col(f"b.{c}").alias(c) for c in (id_col, "pos", "line")]).withColumn("pieces", F.regexp_extract_all("line", F.lit(PIECE), F.lit(0)))
    return own.withColumn("at", (F.array_position(F.transform("pieces", F.lower), F.col("term")) - 1).cast("int")).select(scope, "term", id_col, "pos", "at", "line", "pieces")


def key_ideas(docs: DataFrame, scope: str) -> DataFrame:
    """(scope, doc_id, head, idea): the first line and the summary of the texts that have both. A generator gives the summary, so
    that it is computed once, and only where there is a heading."""
    heads = docs.select(scope, "doc_id", first_line_heading(F.col("text")).alias("head"), "text").filter("head is not null")
    return heads.select(scope, "doc_id", "head", F.explode(F.filter(F.array(summary(F.col("text"))), lambda s: s != "")).alias("idea"))


def with_piece(pieces: Column, at: Column, by: Column) -> Column:
    """A sentence with one of its pieces replaced."""
    return F.array_join(F.transform(pieces, lambda x, i: F.when(i == at, by).otherwise(x)), "")


def distractors(pool: Column, term: Column, sentence: Column, key: Column, k: int) -> Column:
    """Up to ``k`` other terms of a pool: of another stem, not among the sentence's words, not part of the term."""
    words = F.transform(F.regexp_extract_all(sentence, F.lit(PIECE), F.lit(0)), F.lower)
    fine = F.filter(pool, lambda t: (stem(t) != stem(F.lower(term))) & ~F.array_contains(words, t) & ~F.contains(F.lower(term), t))
    return dealt(fine, key, k)


def dealt(options: Column, key: Column, k: int = 100) -> Column:
    """Options in the order of their digests with a key."""
    order = F.array_sort(F.transform(options, lambda t: F.concat(F.md5(F.concat(key, F.lit(":"), t)), t)))
    return F.transform(F.slice(order, 1, k), lambda s: F.substring(s, F.lit(33), F.length(s)))


def _pooled(rows: DataFrame, terms: DataFrame, scope: str, size: int = 40) -> DataFrame:
    pool = terms.filter(F.col("rank") <= size).groupBy(F.col(scope).alias("_scope")).agg(F.array_sort(F.collect_set("term")).alias("_pool"))
    return rows.join(pool, F.col(scope).eqNullSafe(F.col("_scope"))).withColumn("_key", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string"))).drop("_scope")


def blanks(sentences: DataFrame, terms: DataFrame, scope: str) -> DataFrame:
    """(scope, doc_id, prompt, options, answer): sentences with their term left out, and three other terms beside it."""
    asked = _pooled(sentences, terms, scope).withColumn("_wrong", distractors(F.col("_pool"), F.col("term"), F.col("line"), F.col("_key"), 3)).filter(F.size("_wrong") == 3)
    options = dealt(F.concat("_wrong", F.array("term")), F.concat("_key", F.lit("o")))
    return asked.select(scope, "doc_id", F.concat(F.lit("Fill in the blank: "), with_piece(F.col("pieces"), F.col("at"), F.lit(BLANK))).alias("prompt"), options.alias("options"), F.col("term").alias("answer"))


def true_or_false(sentences: DataFrame, terms: DataFrame, scope: str) -> DataFrame:
    """(scope, doc_id, prompt, options, answer): half of the sentences with their term swapped for another one."""
    asked = _pooled(sentences, terms, scope).withColumn("_swap", F.get(distractors(F.col("_pool"), F.col("term"), F.col("line"), F.col("_key"), 1), F.lit(0)))
    false = (F.substring(F.md5("_key"), 1, 1) < "8") & F.col("_swap").isNotNull()
    said = F.when(false, with_piece(F.col("pieces"), F.col("at"), F.col("_swap"))).otherwise(F.col("line"))
    return asked.select(scope, "doc_id", F.concat(F.lit("True or false: "), said).alias("prompt"), F.array(F.lit("True"), F.lit("False")).alias("options"), F.when(false, "False").otherwise("True").alias("answer"))


def short_answers(defined: DataFrame, docs: DataFrame, scope: str) -> DataFrame:
    """(scope, doc_id, prompt, options, answer): what a defined term is, or the key idea of a text with a heading."""
    none = F.array().cast("array<string>").alias("options")
    terms = defined.select(scope, "doc_id", F.concat(F.lit("In your own words, what is "), "term", F.lit("?")).alias("prompt"), none, F.col("definition").alias("answer"))
    return terms.unionByName(key_ideas(docs, scope).select(scope, "doc_id", F.concat(F.lit("Summarize the key idea of “"), "head", F.lit("”.")).alias("prompt"), none, F.col("idea").alias("answer")))


def mixed(kinds: list[tuple[str, DataFrame]], scope: str, most: int) -> DataFrame:
    """(scope, position, kind, doc_id, prompt, options, answer): questions of the kinds in turn, up to ``most`` of a scope;
    of questions with the same prompt, the first."""
    every = None
    for n, (kind, rows) in enumerate(kinds):
        rows = rows.withColumn("kind", F.lit(kind)).withColumn("_kind", F.lit(n))
        every = rows if every is None else every.unionByName(rows)
    once = every.groupBy(scope, F.lower(F.trim("prompt")).alias("_p")).agg(F.min(F.struct("_kind", F.md5("prompt").alias("_d"), "doc_id", "prompt", "kind", "options", "answer")).alias("b")).select(scope, "b.*")
    turn = F.row_number().over(Window.partitionBy(scope, "_kind").orderBy("_d", "doc_id"))
    place = F.row_number().over(Window.partitionBy(scope).orderBy("_turn", "_kind"))
    # Each task cuts a kind of a scope to as many as can be taken before they meet.
    return once.withColumn("_turn", turn).filter(F.col("_turn") <= most).withColumn("position", place.cast("long")).filter(F.col("position") <= most).select(scope, "position", "kind", "doc_id", "prompt", "options", "answer")


def cards(defined: DataFrame, sentences: DataFrame, docs: DataFrame, scope: str, most: int) -> DataFrame:
    """(scope, position, front, back): definitions, then sentences with a blank, then key ideas; each front once."""
    made = [
        defined.select(scope, F.lit(0).alias("_p"), "doc_id", F.concat(F.lit("What is "), "term", F.lit("?")).alias("front"), F.col("definition").alias("back")),
        sentences.select(scope, F.lit(1).alias("_p"), "doc_id", F.concat(F.lit("Fill in the blank: "), with_piece(F.col("pieces"), F.col("at"), F.lit(BLANK))).alias("front"), F.col("term").alias("back")),
        key_ideas(docs, scope).select(scope, F.lit(2).alias("_p"), "doc_id", F.concat(F.lit("Key idea: "), "head").alias("front"), F.col("idea").alias("back")),
    ]
    once = made[0].unionByName(made[1]).unionByName(made[2]).groupBy(scope, F.lower("front").alias("_f")).agg(F.min(F.struct("_p", "doc_id", "front", "back")).alias("b")).select(scope, "b.*")
    place = F.row_number().over(Window.partitionBy(scope).orderBy("_p", "doc_id", "front"))
    return once.withColumn("position", place.cast("long")).filter(F.col("position") <= most).select(scope, "position", "front", "back")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}+|{SPACE}+$", "")


def normalised(items: DataFrame) -> DataFrame:
    """``items`` (kind, prompt, options, answer, ...) that can be used, repaired: prompts trimmed; choices without prefixes,
    empty ones and repeats (case aside), two at least, and their answer as one of them, by text or letter; true or false by
    its synonyms. Others are left out."""
    options = F.filter(F.transform("options", clean_option), lambda o: o != "")
    low = F.transform(options, F.lower)
    options = F.filter(options, lambda o, i: F.array_position(low, F.lower(o)) == i + 1)
    clean = items.withColumn("prompt", _stripped(F.col("prompt"))).withColumn("options", options).withColumn("_a", F.when(F.col("kind") == "mcq", clean_option(F.coalesce("answer", F.lit("")))).otherwise(_stripped(F.col("answer"))))
    by_text = F.get(F.filter("options", lambda o: F.lower(o) == F.lower("_a")), F.lit(0))
    by_letter = F.when(F.col("_a").rlike("^[A-Da-d]$"), F.get("options", F.ascii(F.upper("_a")) - 65))
    answer = F.when(F.col("kind") == "mcq", F.when(F.size("options") >= 2, F.coalesce(by_text, by_letter))).when(F.col("kind") == "true_false", truth(F.col("_a"))).otherwise(F.nullif("_a", F.lit("")))
    kept = clean.withColumn("answer", answer).filter("prompt <> '' and answer is not null")
    shown = F.when(F.col("kind") == "mcq", F.slice("options", 1, 6)).when(F.col("kind") == "true_false", F.array(F.lit("True"), F.lit("False"))).otherwise(F.array().cast("array<string>"))
    return kept.withColumn("options", shown).select(*items.columns)


def student_view(questions: DataFrame) -> DataFrame:
    """Questions without what gives the answer away."""
    return questions.drop("answer", "correct_answer", "explanation")
