"""Relational operators: ingest gates, scope statistics, ownership, windows, counters, maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_in_batch(uploads: DataFrame, scope: str, order: str, text: str) -> DataFrame:
    """Of equal contents in a scope the first stays, later ones name it. Only digests are shuffled, and the first of each is
    a minimum, so that a content that most uploads share is no task of its own."""
    keyed = uploads.select(scope, order, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha256"))
    first = keyed.groupBy(scope, "sha256").agg(F.min(order).alias("first_id")).select(F.col(scope).alias("_scope"), F.col("sha256").alias("_sha"), "first_id")
    found = keyed.join(first, F.col(scope).eqNullSafe(F.col("_scope")) & (F.col("sha256") == F.col("_sha")))
    return found.select(scope, order, "sha256", "first_id", (F.col(order) != F.col("first_id")).alias("duplicate"))


def dedup_against(new: DataFrame, stored: DataFrame, keys: list[str], named: str) -> DataFrame:
    """``new`` with ``existing``: the smallest stored row (``named``) of equal keys, null for what is accepted."""
    held = stored.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(named).alias("existing"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return new.join(held, same, "left").select(*new.columns, "existing")


def counted(parents: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """``parents`` with the counts of ``counts`` (key and numbers), zero where there are none."""
    numbers = [c for c in counts.columns if c != key]
    return parents.join(counts, key, "left").fillna(0, numbers)


def cascade(children: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """The children whose parent is kept."""
    return children.join(kept.select(key).distinct(), key, "left_semi")


def owner_of(rows: DataFrame, chain: list[tuple[DataFrame, str, str]], owner: str) -> DataFrame:
    """``rows`` with their owner, along a chain of parents (table, key in it, what it leads to); those without one are left out."""
    for parents, key, up in chain:
        rows = rows.join(parents.select(key, up), key)
    return rows.withColumnRenamed(chain[-1][2], owner)


def not_in_scope(wanted: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """The requested keys that their scope does not hold."""
    return wanted.select(*keys).distinct().join(held.select(*keys).distinct(), keys, "left_anti")


def newest(rows: DataFrame, scope: str, order: str, tie: str, limit: int, offset: int = 0) -> DataFrame:
    """(scope, position, ...): rows of each scope from the newest, ``limit`` of them after ``offset``."""
    place = F.row_number().over(Window.partitionBy(scope).orderBy(F.desc(order), F.desc(tie)))
    # The bare rank is cut first, so that each task keeps no more rows of a scope than that.
    first = rows.withColumn("_rank", place).filter(F.col("_rank") <= offset + limit)
    return first.withColumn("position", F.col("_rank").cast("long") - 1).drop("_rank").filter(F.col("position") >= offset)


def last_turns(messages: DataFrame, conv: str, turn: str, role: str, text: str, n: int = 6, chars: int = 2000) -> DataFrame:
    """The last ``n`` messages of a conversation in order, without leading assistant turns, cut to ``chars``."""
    tail = messages.withColumn("_back", F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))).filter(F.col("_back") <= n)
    user = F.max((F.col(role) == "user").cast("int")).over(Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0))
    return tail.withColumn("_u", user).filter("_u = 1").select(conv, turn, role, F.substring(text, 1, chars).alias("content"))


def rate_windows(events: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """Hits in windows aligned to the epoch: refused hits count too; ``retry_after`` is the rest of the window."""
    start = (F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds) * seconds).cast("long")
    n = F.row_number().over(Window.partitionBy(key, "window_start").orderBy(ts, "event_id"))
    return (
        events.withColumn("window_start", start)
        .withColumn("n", n.cast("long"))
        .select("event_id", key, "window_start", "n", (F.col("n") > limit).alias("refused"), (F.col("window_start") + seconds - F.unix_timestamp(F.col(ts).cast("timestamp"))).alias("retry_after"))
    )


def failures_since_success(events: DataFrame, key: str, ts: str, failed: Column, succeeded: Column) -> DataFrame:
    order = Window.partitionBy(key).orderBy(ts, "event_id").rowsBetween(Window.unboundedPreceding, 0)
    epoch = events.withColumn("_e", F.sum(succeeded.cast("int")).over(order))
    run = Window.partitionBy(key, "_e").orderBy(ts, "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return epoch.withColumn("failures", F.sum(failed.cast("long")).over(run)).select("event_id", key, "failures")


def totals(rows: DataFrame, count: str) -> DataFrame:
    """One row: how many ``rows`` there are, as ``count``, and the sum of each of their numbers, zero without rows."""
    numbers = [c for c, kind in rows.dtypes if kind in ("int", "bigint", "double", "float") or kind.startswith("decimal")]
    return rows.agg(F.count(F.lit(1)).alias(count), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers])
