"""Grading, citations and spaced repetition as column expressions and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.text import SPACE
from scholion.functions.words import stems, truth

#: Quality of each button, the least ease, and the first two intervals in days.
QUALITY = {"again": 1, "hard": 3, "good": 4, "easy": 5}
LEAST_EASE = 1.3
FIRST = {"hard": 1.0, "good": 1.0, "easy": 4.0}
SECOND = {"hard": 3.0, "good": 6.0, "easy": 8.0}


RELEARN_SECONDS = 600


def _choose(values: dict[str, float], rating: Column) -> Column:
    """The value of a rating, null for one that is not known."""
    return F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))]), rating)


def _rounded(x: Column, digits: int) -> Column:
    """To the nearest, by double arithmetic alone."""
    return F.floor(x * 10**digits + 0.5) / float(10**digits)


def _ease(ease: Column, rating: Column) -> Column:
    gap = 5 - _choose(QUALITY, rating)
    return F.greatest(F.lit(LEAST_EASE), _rounded(ease + 0.1 - gap * (0.08 + gap * 0.02), 3))


def _interval(interval_days: Column, repetitions: Column, ease: Column, rating: Column) -> Column:
    """Days to the next review after an answer other than ``again``."""
    factor = F.when(rating == "hard", 1.2).when(rating == "good", ease).otherwise(ease * 1.3)
    grown = _rounded(F.greatest(interval_days, F.lit(1.0)) * factor, 1)
    return F.when(repetitions == 0, _choose(FIRST, rating)).when(repetitions == 1, _choose(SECOND, rating)).otherwise(grown)


def review(state: Column, rating: Column) -> Column:
    """The state (ease, interval_days, repetitions, lapses, reviews, rating) after one answer; an unknown rating changes nothing."""
    ease, lapse = _ease(state["ease"], rating), rating == "again"
    known = rating.isin(list(QUALITY))
    new = F.struct(
        ease.alias("ease"),
        F.when(lapse, 0.0).otherwise(_interval(state["interval_days"], state["repetitions"], ease, rating)).alias("interval_days"),
        F.when(lapse, 0).otherwise(state["repetitions"] + 1).alias("repetitions"),
        (state["lapses"] + lapse.cast("int")).alias("lapses"),
        (state["reviews"] + 1).alias("reviews"),
        rating.alias("rating"),
    )
    return F.when(F.coalesce(known, F.lit(False)), new).otherwise(state)


def fold_reviews(reviews: DataFrame, card: list[str]) -> DataFrame:
    """Final states of cards from their reviews (ts, rating), in order of time, then of rating, with ``due_at``: ten minutes
    after a lapse, else the interval after the last review, in seconds of the epoch (intervals grow without bound). A card's history is one row: it grows with the
    reviews of one card by one learner."""
    start = F.struct(F.lit(2.5).alias("ease"), F.lit(0.0).alias("interval_days"), F.lit(0).alias("repetitions"), F.lit(0).alias("lapses"), F.lit(0).alias("reviews"), F.lit("").alias("rating"))
    history = reviews.groupBy(*card).agg(F.array_sort(F.collect_list(F.struct("ts", "rating"))).alias("_h"))
    folded = history.select(*card, F.aggregate("_h", start, lambda s, r: review(s, r["rating"])).alias("s"), F.element_at("_h", -1)["ts"].alias("last_reviewed_at")).select(*card, "s.*", "last_reviewed_at")
    wait = F.when(F.col("rating") == "again", F.lit(float(RELEARN_SECONDS))).otherwise(F.col("interval_days") * 86_400.0)
    return folded.withColumn("due_at", F.unix_micros(F.col("last_reviewed_at").cast("timestamp")) / 1e6 + wait).drop("rating")


def next_interval(rating: str) -> Column:
    """Days to the next review of a card (ease, interval_days, repetitions), should it be answered so."""
    if rating == "again":
        return F.lit(RELEARN_SECONDS) / F.lit(86_400.0)
    ease = _ease(F.col("ease"), F.lit(rating))
    return _interval(F.col("interval_days"), F.col("repetitions"), ease, F.lit(rating)).cast("double")


def due_queue(cards: DataFrame, deck: str, position: str, limit: int) -> DataFrame:
    """The cards due by ``now``, the longest due first, then by position, up to ``limit`` of a deck."""
    place = F.row_number().over(Window.partitionBy(deck).orderBy("due_at", position))
    return cards.filter(F.col("due_at") <= F.col("now")).withColumn("position", place.cast("long")).filter(F.col("position") <= limit)


def deck_summary(cards: DataFrame, deck: str, reviewed: Column) -> DataFrame:
    return cards.groupBy(deck).agg(F.count(F.lit(1)).alias("cards"), F.count_if(F.col("due_at") <= F.col("now")).alias("due"), F.count_if(reviewed).alias("reviewed"))


def reset_progress(cards: DataFrame, decks: DataFrame, deck: str, now: Column) -> DataFrame:
    """Cards of the named decks as new ones, due now."""
    new = {"ease": F.lit(2.5), "interval_days": F.lit(0.0), "repetitions": F.lit(0), "lapses": F.lit(0), "reviews": F.lit(0), "last_reviewed_at": F.lit(None), "due_at": now}
    marked = cards.join(decks.select(deck).distinct().withColumn("_reset", F.lit(True)), deck, "left")
    return marked.select(*[F.when(F.col("_reset"), new[c].cast(cards.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in cards.columns])


def _blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(rf"^{SPACE}*$")


def grade_short_answer(given: Column, reference: Column) -> Column:
    """Share of the reference's stems in the answer: from a half 1, from a quarter 0.5, else 0; blank answers 0."""
    want, got = F.array_distinct(stems(reference)), stems(given)
    share = F.size(F.array_intersect(want, got)) / F.size(want)
    return F.when(_blank(given), 0.0).when(F.size(want) == 0, 1.0).when(share >= 0.5, 1.0).when(share >= 0.25, 0.5).otherwise(0.0)


def grade(kind: Column, given: Column, correct: Column) -> Column:
    """(score, feedback) of one answer; a short answer names up to eight of the terms it shares with the reference."""
    want = F.array_distinct(stems(correct))
    matched = F.array_sort(F.array_intersect(want, stems(given)))
    named = F.when(F.size(matched) > 0, F.concat(F.lit(": "), F.array_join(F.slice(matched, 1, 8), ", "))).otherwise("")
    said = F.concat(F.lit("Matched "), F.size(matched).cast("string"), F.lit(" of "), F.size(want).cast("string"), F.lit(" key terms"), named)
    exact = F.when(kind == "true_false", F.coalesce(truth(given) == truth(correct), F.lit(False))).otherwise(F.lower(F.trim(given)) == F.lower(F.trim(correct)))
    score = F.when(_blank(given), 0.0).when(kind == "short_answer", grade_short_answer(given, correct)).otherwise(exact.cast("double"))
    return F.struct(score.alias("score"), F.when(_blank(given), "No answer given.").when((kind == "short_answer") & (F.size(want) > 0), said).otherwise("").alias("feedback"))


def citations(answer: Column, sources: Column) -> Column:
    """Numbers cited as [1] or [1, 3], each once, in order, from 1 to ``sources``."""
    lists = F.regexp_extract_all(answer, F.lit(r"\[(\d+(?:\s*[,，]\s*\d+)*)\]"), F.lit(1))
    numbers = F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, r"\s*[,，]\s*"))), lambda n: n.try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: n.between(1, sources)))


#: What a generator gives for a question: its kind, text, options, answer, explanation and the number of its source.
ITEM = "kind string, prompt string, options array<string>, answer string, explanation string, source_id int"


def with_sources(items: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Generated items with a snapshot of the source that they name by number; null where there is no such source. Of a source
    (key, index, source struct), what depends on the question is dropped."""
    shown = [c for c in sources.schema["source"].dataType.names if c in ("index", "score", "vector_score", "keyword_score", "cited")]
    kept = sources.select(F.col(key).alias("_k"), F.col("index").alias("_i"), (F.col("source").dropFields(*shown) if shown else F.col("source")).alias("source"))
    return items.join(kept, (F.col(key) == F.col("_k")) & (F.col("source_id") == F.col("_i")), "left").drop("_k", "_i")


def cited_sources(sources: Column, answer: Column) -> Column:
    """The sources (structs with an index) with a mark on those that the answer cites."""
    cited = citations(answer, F.size(sources))
    return F.transform(sources, lambda s: s.withField("cited", F.array_contains(cited, s["index"].cast("int"))))


def deck_label(sources: DataFrame, key: str, name: str) -> DataFrame:
    """(key, label): the most common name, ties by alphabet, and how many others there are."""
    counts = sources.groupBy(key, name).agg(F.count(F.lit(1)).alias("_n"))
    by = counts.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("_n"), F.col(name).alias("_m")))["_m"].alias("_m"), F.count(F.lit(1)).alias("_d"))
    return by.select(key, F.when(F.col("_d") == 1, F.col("_m")).otherwise(F.concat("_m", F.lit(" and "), (F.col("_d") - 1).cast("string"), F.lit(" more"))).alias("label"))


def quiz_summary(quizzes: DataFrame, questions: DataFrame, attempts: DataFrame, key: str) -> DataFrame:
    """(key, questions, attempts, best): counts of a quiz and its best score, null before the first attempt."""
    asked = questions.groupBy(key).agg(F.count(F.lit(1)).alias("questions"))
    tried = attempts.groupBy(key).agg(F.count(F.lit(1)).alias("attempts"), F.max("score").alias("best"))
    return quizzes.select(key).join(asked, key, "left").join(tried, key, "left").fillna(0, ["questions", "attempts"])


def unknown_answers(answers: DataFrame, questions: DataFrame, keys: list[str]) -> DataFrame:
    """The answers to questions that the quiz does not have."""
    return answers.join(questions.select(*keys).distinct(), keys, "left_anti")
