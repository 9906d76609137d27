"""Evaluation of searches: what is relevant to labelled questions, first ranks, the gate, and reports that are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.operators.search import metrics

#: Questions of this category have no target; they count for abstention only.
UNANSWERABLE = "unanswerable"


def relevance(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """``hits`` (query_id, file, page, section, ...) with ``relevant``: whether a target (query_id, file, page, section) of the
    question names the hit's file and its page or its section. A page or section that is missing on either side equals nothing.
    Hits and targets meet by question and file; a hit that several targets name is one row."""
    wanted = targets.filter("file is not null").groupBy("query_id", "file").agg(F.collect_set("page").alias("_pages"), F.collect_set("section").alias("_sections"))
    wanted = wanted.select(F.col("query_id").alias("_q"), F.col("file").alias("_f"), "_pages", "_sections")
    met = hits.join(wanted, (F.col("query_id") == F.col("_q")) & (F.col("file") == F.col("_f")), "left")
    either = [F.coalesce(F.array_contains(list_, F.col(c)), F.lit(False)) for list_, c in (("_pages", "page"), ("_sections", "section"))]
    return met.withColumn("relevant", either[0] | either[1]).select(*hits.columns, "relevant")


def first_ranks(questions: DataFrame, labelled: DataFrame, modes: list[str]) -> DataFrame:
    """(query_id, category, mode, rank): for every question (query_id, category) and mode the first relevant rank of
    ``labelled`` (query_id, mode, rank, relevant), null if there is none."""
    first = labelled.filter("relevant").groupBy("query_id", "mode").agg(F.min("rank").alias("rank"))
    every = questions.select("query_id", "category").distinct().withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    return every.join(first, ["query_id", "mode"], "left").select("query_id", "category", "mode", "rank")


def summary(ranks: DataFrame) -> DataFrame:
    """(mode, category, n, recall_1, recall_3, recall_5, mrr) of ``first_ranks``, of all answerable questions and by category."""
    return metrics(ranks.filter(F.col("category") != UNANSWERABLE))


def gate(summaries: DataFrame, least: float, mode: str = "hybrid", measure: str = "recall_5") -> DataFrame:
    """(mode, measure, value, passed): one row that says whether a mode reaches ``least`` over all questions; without
    questions it does not."""
    found = summaries.filter((F.col("mode") == mode) & (F.col("category") == "all")).agg(F.max(measure).alias("value"))
    return found.select(F.lit(mode).alias("mode"), F.lit(measure).alias("measure"), "value", (F.coalesce("value", F.lit(0.0)) >= least).alias("passed"))


def write_report(ranks: DataFrame, summaries: DataFrame, flagged: DataFrame, path: str) -> None:
    """The report as JSON lines, in three folders under ``path``: a row for each question with its ranks by mode, the
    summaries, and how often questions were flagged (``search.abstention``)."""
    by = ranks.groupBy("query_id", "category").agg(F.map_from_entries(F.collect_list(F.struct("mode", "rank"))).alias("ranks"))
    for name, rows in (("questions", by), ("metrics", summaries), ("abstention", flagged)):
        rows.write.mode("overwrite").json(f"{path}/{name}")


def markdown_lines(summaries: DataFrame, categories: tuple[str, ...] = ("all", "paraphrase")) -> DataFrame:
    """(position, line): a Markdown table, a row for each mode, of recall and reciprocal rank over all questions and by category."""
    shown = [(c, m) for c in categories for m in (("recall_1", "recall_3", "recall_5", "mrr") if c == "all" else ("recall_1", "mrr"))]
    title = {"recall_1": "Recall@1", "recall_3": "Recall@3", "recall_5": "Recall@5", "mrr": "MRR"}
    cell = lambda c, m: F.coalesce(F.format_string("%.2f", F.max(F.when(F.col("category") == c, F.col(m)))), F.lit(""))
    rows = summaries.groupBy("mode").agg(F.concat(F.lit("| "), F.first("mode"), *[x for c, m in shown for x in (F.lit(" | "), cell(c, m))], F.lit(" |")).alias("line"))
    head = ["| Retriever | " + " | ".join(title[m] + (f" ({c})" if c != "all" else "") for c, m in shown) + " |", "|-" * (len(shown) + 1) + "|"]
    first = summaries.sparkSession.createDataFrame(list(enumerate(head)), "position int, line string")
    return first.unionByName(rows.select(F.lit(len(head)).alias("position"), "line"))


def write_lines(lines: DataFrame, path: str, order: list[str], by: str | None = None) -> None:
    """Text files of the lines (column line) in their order; with ``by``, a folder for each of its values, whose files give its lines
    in the order of their names. Lines are dealt by ranges, so a large file is several, and none passes one task."""
    keys = [*([by] if by else []), *order]
    dealt = lines.repartitionByRange(*keys).sortWithinPartitions(*keys)
    writer = dealt.select("line", *([by] if by else [])).write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).text(path)
