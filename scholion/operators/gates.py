"""Gates on files and batches, and the state of sessions and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.functions.words import LEGACY, TYPES, file_type


def file_error(name: Column, content: Column, most_bytes: int) -> Column:
    """The reason why a file is refused, or null: its type, its size, or a content that its type cannot have."""
    kind = file_type(name)
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    return (
        F.when(kind.isin(LEGACY), "legacy_type")
        .when(~kind.isin(TYPES), "unsupported_type")
        .when(F.octet_length(content) > most_bytes, "too_large")
        .when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "empty_file")
        .when((kind == "pdf") & ~head.rlike(r"^[ \t\n\r\f\x0B]*%PDF"), "not_a_pdf")
        .when(kind.isin("pptx", "docx") & ~head.rlike(r"^PK\x03\x04"), "not_an_archive")
    )


def batch_errors(uploads: DataFrame, batch: str, error: str, most: int) -> DataFrame:
    """(batch, files, accepted, error): a batch fails whole when it has too many files or none is accepted."""
    counts = uploads.groupBy(batch).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col(error).isNull()).alias("accepted"))
    return counts.withColumn("error", F.when(F.col("files") > most, "too_many_files").when(F.col("accepted") == 0, "none_accepted"))


def session_state(revoked: Column, expires: Column, seen: Column, active: Column, now: Column, idle_seconds: int) -> Column:
    """revoked, expired, idle, disabled or active, the first that holds; a session not found (no expiry) is unknown."""
    idle = F.unix_timestamp(seen.cast("timestamp")) + idle_seconds <= F.unix_timestamp(now.cast("timestamp"))
    return F.when(expires.isNull(), "unknown").when(revoked.isNotNull(), "revoked").when(expires <= now, "expired").when(idle, "idle").when(~active, "disabled").otherwise("active")
