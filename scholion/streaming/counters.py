"""Streams: fixed-window counters with a watermark, and duplicate suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, key: str, ts: str, seconds: int, late: str = "1 hour") -> DataFrame:
    """Hits by key in tumbling windows aligned to the epoch; events later than ``late`` are dropped."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", f"{seconds} seconds").alias("w"), key).agg(F.count(F.lit(1)).alias("hits")).select(key, F.unix_timestamp("w.start").alias("window_start"), "hits")


def first_uploads(uploads: DataFrame, scope: str, ts: str, text: str, stored: DataFrame | None = None, late: str = "1 day") -> DataFrame:
    """Of equal contents in a scope, the first within the watermark, unless ``stored`` (scope, sha256) has it, as it was when the
    stream began."""
    first = uploads.withColumn("sha256", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).withWatermark(ts, late).dropDuplicatesWithinWatermark([scope, "sha256"])
    if stored is None:
        return first
    held = stored.select(F.col(scope).alias("_scope"), F.col("sha256").alias("_sha")).distinct()
    return first.join(held, F.col(scope).eqNullSafe(F.col("_scope")) & (F.col("sha256") == F.col("_sha")), "left_anti")
