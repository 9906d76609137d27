"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.llm.common import written


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one batch as stars: a node and the smallest node that the batch connects it to."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = parent[x]
            return x

        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(x, root(x)) for x in list(parent)]
        yield pa.record_batch({"u": pa.array([x for x, r in pairs if x != r], pa.int64()), "v": pa.array([r for x, r in pairs if x != r], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of ``edges`` (columns u, v, long), the smallest node of its component.

    Every round makes each node's neighbours point at the smallest of them, larger neighbours first and
    then smaller ones; the edges are written to the shared folder after each round, and it ends when a
    round changes nothing, after about log2 of the longest path. Minima combine before the shuffle,
    and the joins that hand them back can be split, so a hub needs no task of its own. Loops and
    repeated edges do no harm; no edges give no rows.
    """
    now = written(edges.filter("u <> v").select("u", "v").mapInArrow(_forest, "u long, v long").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.col("u").alias("_w"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").withColumn("_k", F.col("u")).join(least, (F.col("u") == F.col("_u")) & (F.col("_k") == F.col("_w"))).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "edges")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.col("u").alias("_w"), "m")
        small = down.withColumn("_k", F.col("u")).join(least, (F.col("u") == F.col("_u")) & (F.col("_k") == F.col("_w"))).select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        now = written(small, "edges")
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == state:
            break
        state = seen
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
