"""Sources and sinks: tables by name, labelled questions, deck export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A file of labelled questions.
QUESTIONS = "questions array<struct<id:string,category:string,question:string,relevant:array<struct<file:string,page:int,section:string>>>>"


def questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, category, query) and the targets (query_id, file, page, section) of a JSON file of labelled questions with nested
    targets; questions without a target have none."""
    asked = spark.read.schema(QUESTIONS).option("multiLine", True).json(path).select(F.inline("questions"))
    targets = asked.select(F.col("id").alias("query_id"), F.inline("relevant"))
    return asked.select(F.col("id").alias("query_id"), "category", F.col("question").alias("query")), targets


def deck_line(front: Column, back: Column, tag: Column | None = None) -> Column:
    """A line of an import file: fields by tabs, with tabs and line breaks in them flattened."""
    return F.concat_ws("\t", *[F.trim(F.regexp_replace(c, r"[\t\r\n]+", " ")) for c in (front, back, tag) if c is not None])


#: The lines at the head of an import file, without and with a column of tags.
DECK_HEAD, DECK_TAGS = ("#separator:tab", "#html:false"), "#tags column:3"


def deck_file(cards: DataFrame, deck: str, tag: str | None = None) -> DataFrame:
    """(deck, position, line) of import files: for each deck its head, then its cards (deck, position, front, back) in
    order. ``evaluation.write_lines`` writes them."""
    head = [*DECK_HEAD, *([DECK_TAGS] if tag else [])]
    heads = cards.select(deck).distinct().select(deck, F.posexplode(F.array(*map(F.lit, head))).alias("_n", "line"))
    heads = heads.select(deck, (F.col("_n") - len(head)).cast("long").alias("position"), "line")
    line = deck_line(F.col("front"), F.col("back"), F.col(tag) if tag else None)
    return heads.unionByName(cards.select(deck, F.col("position").cast("long").alias("position"), line.alias("line")))
