"""Generators of questions and cards that can be exchanged: functions from prompts to raw text, whose output is read by a schema.

A generator takes (key, count, message, sources) and gives (key, raw): a JSON object, perhaps in prose or a code fence. What it
says is checked against ``SCHEMAS`` and put to use, or set aside with the reason.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.formats import json_object
from scholion.operators.quiz import normalised
from scholion.operators.study import with_sources

#: What items of each task look like, as generators give them.
SCHEMAS = {
    "quiz": "questions array<struct<kind:string,prompt:string,options:array<string>,answer:string,explanation:string,source_id:int>>",
    "cards": "cards array<struct<front:string,back:string,source_id:int>>",
}

Generator = Callable[[DataFrame], DataFrame]
#: Generators by task and name.
GENERATORS: dict[tuple[str, str], Generator] = {}


def register(task: str, name: str) -> Callable[[Generator], Generator]:
    if task not in SCHEMAS:
        raise ValueError(f"no task {task!r}; there are {sorted(SCHEMAS)}")

    def add(f: Generator) -> Generator:
        GENERATORS[task, name] = f
        return f

    return add


def generated(prompts: DataFrame, task: str, name: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, place, fields of an item) and (key, error, raw): the items that the generator ``name`` gives for ``prompts``, and
    the answers that are no JSON object, do not fit the schema, or hold no items."""
    if (task, name) not in GENERATORS:
        raise ValueError(f"no generator {name!r} for {task!r}; there are {sorted(n for t, n in GENERATORS if t == task)}")
    raw = GENERATORS[task, name](prompts).select(key, "raw")
    field = SCHEMAS[task].split()[0]
    # A value that does not fit, anywhere, marks its answer.
    read = raw.withColumn("_j", json_object(F.col("raw"))).withColumn("_s", F.from_json("_j", f"{SCHEMAS[task]}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    error = F.when(F.col("_j").isNull(), "no_json").when(F.col("_s").isNull() | F.col("_s._bad").isNotNull(), "schema").when(F.coalesce(F.size(f"_s.{field}"), F.lit(0)) < 1, "no_items")
    read = read.withColumn("error", error)
    items = read.filter("error is null").select(key, F.posexplode(f"_s.{field}").alias("place", "_i")).filter("_i is not null").select(key, "place", "_i.*")
    return items, read.filter("error is not null").select(key, "error", "raw")


def _first(items: DataFrame, key: str, text: Column, most: Column | int) -> DataFrame:
    """Of a key's items with the same text (case aside) the first, numbered from 1, up to ``most``; without them, as they came."""
    unseen = F.row_number().over(Window.partitionBy(key, "_text").orderBy("place"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("place"))
    once = items.withColumn("_text", F.lower(F.trim(text))).withColumn("_u", unseen).filter("_u = 1")
    return once.withColumn("position", place.cast("long")).filter(F.col("position") <= most).drop("_text", "_u", "place")


def accepted_questions(items: DataFrame, sources: DataFrame, allowed: DataFrame, key: str, most: int) -> DataFrame:
    """(key, kind, prompt, options, answer, explanation, source, position): of generated questions those that can be used
    (``normalised``) and whose kind is among those ``allowed`` (key, kind) for the quiz, each prompt once, up to ``most``, with a snapshot
    of the source (key, index, source) that they name."""
    kinds = allowed.select(F.col(key).alias("_k"), F.col("kind").alias("_kind")).distinct()
    fit = normalised(items).join(kinds, (F.col(key) == F.col("_k")) & (F.col("kind") == F.col("_kind")), "left_semi")
    return with_sources(_first(fit, key, F.col("prompt"), most), sources, key).drop("source_id")


def accepted_cards(items: DataFrame, sources: DataFrame, key: str, most: int) -> DataFrame:
    """(key, front, back, source, position): of generated cards those with both sides, each front once, up to ``most``, with a
    snapshot of the source that they name."""
    sides = items.withColumn("front", F.trim(F.coalesce("front", F.lit("")))).withColumn("back", F.trim(F.coalesce("back", F.lit(""))))
    return with_sources(_first(sides.filter("front <> '' and back <> ''"), key, F.col("front"), most), sources, key).drop("source_id")
