"""Streams with state by key that ends with its time: limits and failures in windows, sessions, and answers from token events.

State is that of ``transformWithState``: values with a lifetime or timers on event time, in RocksDB, which ``by_key`` names as the session's
store. (No column of a row may begin with an underscore there.) Inputs have a watermark; rows behind it are dropped. A batch's rows of a key are put in order of time first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def by_key(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "EventTime")


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> list[tuple]:
    parts = [r for r in rows if len(r)]
    return list(pd.concat(parts).sort_values(by)[by].itertuples(index=False, name=None)) if parts else []


class _Windows(StatefulProcessor):
    """The running number of hits, or of failures since a success, in the window that is the key."""

    def __init__(self, seconds: int, limit: int) -> None:
        self.seconds, self.limit = seconds, limit

    def init(self, handle) -> None:
        self.handle, self.count = handle, handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.count.exists():
            self.handle.registerTimer((key[1] + self.seconds) * 1000)
        n = self.count.get()[0] if self.count.exists() else 0
        out = []
        for _, event, second, ok in _ordered(rows, ["time", "event_id", "second", "ok"]):
            n = 0 if ok else n + 1
            out.append((event, key[0], key[1], n, n > self.limit, key[1] + self.seconds - second))
        self.count.update((n,))
        yield pd.DataFrame(out, columns=["event_id", "key", "window_start", "n", "refused", "retry_after"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.count.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def limited(events: DataFrame, key: str, ts: str, seconds: int, limit: int, ok: str | None = None, late: str = "1 hour") -> DataFrame:
    """(event_id, key, window_start, n, refused, retry_after) of events (event_id long, key, ts): a verdict for each of them as it
    comes. With ``ok`` (boolean column) only failures count, and a success clears them, each window for itself. A window's
    state goes with the window."""
    second = F.unix_timestamp(F.col(ts).cast("timestamp"))
    rows = events.select("event_id", F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("time"), second.alias("second"), (F.col(ok) if ok else F.lit(False)).alias("ok"))
    rows = rows.withColumn("window_start", (F.floor(F.col("second") / seconds) * seconds).cast("long")).withWatermark("time", late)
    kind = dict(rows.dtypes)["key"]
    return by_key(rows, ["key", "window_start"], _Windows(seconds, limit), f"event_id long, key {kind}, window_start long, n long, refused boolean, retry_after long")


class _Sessions(StatefulProcessor):
    """Sessions by event time: events wait for the watermark, then go in order into the open session."""

    def __init__(self, idle: int, longest: int) -> None:
        self.idle, self.longest = idle * 1_000_000, longest * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting, self.open = handle.getListState("waiting", "t long"), handle.getValueState("open", "run long, started long, ended long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            times = part["micros"].tolist() if len(part) else []
            self.waiting.appendList([(t,) for t in times])
            for ms in {t // 1000 for t in times}:
                self.handle.registerTimer(ms + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(t for (t,) in self.waiting.get()) if self.waiting.exists() else []
        session, out = self.open.get() if self.open.exists() else None, []
        for t in (t for t in waiting if t <= mark):
            if session is not None and t - session[2] < self.idle and (t - session[0]) // self.longest == (session[1] - session[0]) // self.longest:
                session = session[0], session[1], t, session[3] + 1
                continue
            run = session[0] if session is not None and t - session[2] < self.idle else t
            if session is not None:
                out.append((key[0], *session[1:]))
            session = run, t, t, 1
        rest = [t for t in waiting if t > mark]
        if session is not None and mark >= session[2] + self.idle:
            out.append((key[0], *session[1:]))
            session = None
        if session is None:
            self.open.clear()
        else:
            self.open.update(session)
            self.handle.registerTimer((session[2] + self.idle) // 1000 + 1)
        if rest:
            self.waiting.put([(t,) for t in rest])
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["key", "started", "ended", "n"])

    def close(self) -> None:
        pass


def sessions(events: DataFrame, user: str, ts: str, idle: int, longest: int, late: str = "1 hour") -> DataFrame:
    """(key, started, ended, n): the sessions of ``idle_sessions``, each once it is over by the watermark. State holds the
    open session and the events that the watermark has not reached; a session without news ends by its timer."""
    rows = events.select(F.col(user).alias("key"), F.col(ts).cast("timestamp").alias("time")).withColumn("micros", F.unix_micros("time")).withWatermark("time", late)
    return by_key(rows, ["key"], _Sessions(idle, longest), f"key {dict(rows.dtypes)['key']}, started long, ended long, n long")


class _Answers(StatefulProcessor):
    """Tokens by number until the last one is there, then that the answer is given."""

    def __init__(self, hours: int) -> None:
        self.ms = hours * 3_600_000

    def init(self, handle) -> None:
        self.handle = handle
        self.tokens, self.size = handle.getMapState("tokens", "seq long", "token string"), handle.getValueState("size", "n long, given boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        size, given = self.size.get() if self.size.exists() else (-1, False)
        seen = 0
        for part in rows:
            if not len(part):
                continue
            seen = max(seen, int(part["millis"].max()))
            for seq, token, done in part[["seq", "token", "done"]].itertuples(index=False, name=None):
                size = seq + 1 if done else size
                if not given and not self.tokens.containsKey((seq,)):
                    self.tokens.updateValue((seq,), (token,))
        self.handle.registerTimer(seen + self.ms)
        held = {} if given or size < 0 else {k[0]: v[0] for k, v in self.tokens.iterator()}
        out = []
        if len(held) >= size > 0 and all(k in held for k in range(size)):
            out.append((*key, "".join(held[k] for k in range(size)), size))
            given = True
            self.tokens.clear()
        self.size.update((size, given))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "answer", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for timer in list(self.handle.listTimers()):
            if timer > expiredTimerInfo.getExpiryTimeInMs():
                yield pd.DataFrame()
                return
        self.tokens.clear()
        self.size.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def answers(events: DataFrame, ts: str, hours: int = 1, late: str = "10 minutes") -> DataFrame:
    """(conv_id, turn, answer, n) of token events (conv_id, turn, seq from 0, token, done with the last one, ts): each
    answer once, when all its tokens are there, in whatever order they came. Repeated events change nothing, and an answer
    that stays incomplete goes ``hours`` after its last event."""
    rows = events.select("conv_id", "turn", "seq", "token", "done", F.col(ts).cast("timestamp").alias("time")).withColumn("millis", F.unix_millis("time")).withWatermark("time", late)
    kinds = dict(rows.dtypes)
    return by_key(rows, ["conv_id", "turn"], _Answers(hours), f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, answer string, n long")
