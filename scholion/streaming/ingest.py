"""Streams that keep state: incremental ingest, and review states of cards."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scholion.operators.ingest import ingest_batch
from scholion.operators.study import FIRST, LEAST_EASE, QUALITY, SECOND


def ingested(docs: DataFrame, index: str, checkpoint: str, stream: str = "ingest"):
    """A started stream (doc_id, text, and scope if there is one) whose documents go into ``index`` a batch at a time, each batch as one version and
    once, also if it is replayed; a document that comes again replaces its chunks."""

    def batch(rows: DataFrame, number: int) -> None:
        ingest_batch(rows, index, stream, number)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def card_states(reviews: DataFrame, card: str = "card", late: str = "1 day") -> DataFrame:
    """The state of each card after each batch of reviews (card, ts, rating), by the same steps as ``fold_reviews``. Reviews
    are in order of time inside a batch; those behind the watermark are dropped, and unknown ratings change nothing."""
    kind = dict(reviews.dtypes)[card]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ease, days, repetitions, lapses, n = state.get if state.exists else (2.5, 0.0, 0, 0, 0)
        rows = pd.concat(batches).sort_values(["ts", "rating"])
        for rating in rows["rating"]:
            if rating not in QUALITY:
                continue
            gap = 5 - QUALITY[rating]
            ease = max(LEAST_EASE, int((ease + 0.1 - gap * (0.08 + gap * 0.02)) * 1000 + 0.5) / 1000)
            if rating == "again":
                days, repetitions, lapses = 0.0, 0, lapses + 1
            else:
                grown = int(max(days, 1.0) * {"hard": 1.2, "good": ease, "easy": ease * 1.3}[rating] * 10 + 0.5) / 10
                days = FIRST[rating] if repetitions == 0 else SECOND[rating] if repetitions == 1 else grown
                repetitions += 1
            n += 1
        state.update((ease, days, repetitions, lapses, n))
        yield pd.DataFrame({card: [key[0]], "ease": [ease], "interval_days": [days], "repetitions": [repetitions], "lapses": [lapses], "reviews": [n]})

    grouped = reviews.withWatermark("ts", late).groupBy(card)
    fields = "ease double, interval_days double, repetitions int, lapses int, reviews int"
    return grouped.applyInPandasWithState(step, f"{card} {kind}, {fields}", fields, "update", GroupStateTimeout.NoTimeout)
