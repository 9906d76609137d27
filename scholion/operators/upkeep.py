"""Maintenance of stored tables: purges, owners, partial updates, idempotent creation, sessions. Each is one pass or one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dead(expires: Column, ended: Column, now: Column, keep_days: int = 7) -> Column:
    """Whether a session or token can go: past its end, or revoked or used more than ``keep_days`` ago."""
    return F.coalesce(expires <= now, F.lit(False)) | F.coalesce(ended < now - F.make_dt_interval(F.lit(keep_days)), F.lit(False))


def assign_owners(rows: DataFrame, owners: DataFrame, key: str, owner: str, force: bool = False) -> DataFrame:
    """Rows with the owner that ``owners`` (key, owner; a key once) names: those without one, or with ``force`` all named ones."""
    named = owners.select(F.col(key), F.col(owner).alias("_new"))
    order = ("_new", owner) if force else (owner, "_new")
    return rows.join(named, key, "left").withColumn(owner, F.coalesce(*order)).drop("_new")


def partial_update(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the trimmed values of ``changes`` (a key once); a blank or missing value leaves the old one."""
    new = changes.select(F.col(key), *[F.nullif(F.trim(c), F.lit("")).alias(f"_{c}") for c in columns])
    return rows.join(new, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def missing(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Of the wanted natural keys those not stored yet, once each; null keys equal null keys."""
    s = stored.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return wanted.select(*keys).distinct().join(s, same, "left_anti")


def revoke(sessions: DataFrame, users: DataFrame, user: str, revoked: str, now: Column) -> DataFrame:
    """Sessions with ``revoked`` set to ``now`` where they are live and their user is among ``users``."""
    named = users.select(user).distinct().withColumn("_named", F.lit(True))
    return sessions.join(named, user, "left").withColumn(revoked, F.coalesce(revoked, F.when(F.col("_named"), now))).drop("_named")


def idle_sessions(events: DataFrame, user: str, ts: str, idle: int, longest: int) -> DataFrame:
    """(user, started, ended, n): runs of events without a gap of ``idle`` seconds or more, cut every ``longest`` seconds from their start."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    order = Window.partitionBy(user).orderBy("_s")
    gap = F.coalesce(F.col("_s") - F.lag("_s").over(order) >= idle * 1_000_000, F.lit(True))
    runs = events.select(F.col(user), seconds.alias("_s")).withColumn("_new", gap.cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    part = F.floor((F.col("_s") - F.min("_s").over(Window.partitionBy(user, "_run"))) / (longest * 1_000_000))
    return runs.withColumn("_part", part).groupBy(user, "_run", "_part").agg(F.min("_s").alias("started"), F.max("_s").alias("ended"), F.count(F.lit(1)).alias("n")).drop("_run", "_part")


def valid_tokens(tokens: DataFrame, user: str, order: list[str], used: Column, expires: Column, now: Column) -> DataFrame:
    """The newest token of each user, if it is neither used nor expired: older ones are superseded by it."""
    newest = tokens.groupBy(user).agg(F.max(F.struct(*order, used.alias("_used"), expires.alias("_expires"), now.alias("_now"))).alias("t"))
    return newest.filter(F.col("t._used").isNull() & (F.col("t._expires") > F.col("t._now"))).select(user, *[F.col(f"t.{c}").alias(c) for c in order])


def orphans(rows: DataFrame, owner: str) -> DataFrame:
    """The rows that nobody owns; none may be left once owners are required."""
    return rows.filter(F.col(owner).isNull())


def with_owner(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows, written before there were owners, and new ones together: the owner of old ones is null."""
    return old.unionByName(new, allowMissingColumns=True)


def backfilled(states: DataFrame, signature: str, current: Column) -> DataFrame:
    """States whose ready documents have a signature: those without one get the current one."""
    return states.withColumn(signature, F.coalesce(signature, F.when(F.col("status") == "ready", current)))


def window_key(scope: Column, identifier: Column, seconds: int, at: Column) -> Column:
    """The digest under which a window's counter is kept: no identifier is stored in the clear."""
    start = (F.floor(F.unix_timestamp(at.cast("timestamp")) / seconds) * seconds).cast("long")
    return F.sha2(F.concat_ws(":", scope, identifier.cast("string"), F.lit(seconds).cast("string"), start.cast("string")), 256)
