"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into geometric buckets, and buckets into blocks of bounded size. Every
query is first answered on one block of the longest vectors, which gives it a score to beat. Against
every other block that score becomes a *local cosine threshold*, score / (|query| * longest vector of
the block), and each query of a block is pruned by what pays there:

* above 1, no vector of the block can reach the score: the block is skipped;
* high, the query's largest coordinate bounds the same coordinate of any vector that reaches it, so
  only a range of the block's list sorted by that coordinate is verified;
* low, only length prunes: the vectors long enough are a prefix of the block and are verified.

What is verified is the integer product itself, so results are exact. The queries are blocks too. Before any block moves,
block numbers alone are matched: a query block goes to the vector blocks whose longest vector is long enough for the least
demanding of its queries, so most pairs of blocks never meet where lengths differ. Nothing that grows is broadcast, and no task
sees more than one block of each side at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.llm.common import written

BLOCK, QUERIES = 8192, 2048
#: Lengths of a bucket differ by 5 % at most.
RATIO = 1.05
#: From this local cosine on, the coordinate lists are used.
COORDINATE_FROM = 0.6
#: Query blocks that share a copy of the block of the longest vectors, and dimensions and buckets sent to every task.
SHARED, BROADCAST_ROWS = 8, 100_000
_PACKED = "_dim int, _at long, _ids binary, _rows binary, _width int, _longest double"


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    """One row for a block: ids and components, longest vectors first, in the smallest integers that hold them."""
    ids = rows.column("_id").to_numpy().astype(np.int64)
    v = rows.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(ids), -1)
    square = (v.astype(np.float64) ** 2).sum(1)
    order = np.lexsort((ids, -square))
    low, high = int(v.min(initial=0)), int(v.max(initial=0))
    kind = next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return pa.table({
        "_dim": pa.array([v.shape[1]], pa.int32()), "_at": pa.array([key[1].as_py()], pa.int64()), "_ids": [ids[order].tobytes()], "_rows": [v[order].astype(kind).tobytes()],
        "_width": pa.array([np.dtype(kind).itemsize], pa.int32()), "_longest": [float(np.sqrt(square.max()))],
    })


def _unpack(ids: bytes, rows: bytes, dim: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(rows, f"i{width}").astype(np.int64).reshape(len(i), dim)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact: in doubles where every sum stays below 2^53, else in integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    return q @ v.T


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query's candidates that reach ``least``, ties to the smaller id."""
    keep = (scores >= least) & (ids != own)
    s, i = scores[keep], ids[keep]
    if len(s) > k:
        cut = s >= np.partition(s, len(s) - k)[len(s) - k]
        s, i = s[cut], i[cut]
    order = np.lexsort((i, -s))[:k]
    return s[order], i[order]


def _search(qi: np.ndarray, q: np.ndarray, vi: np.ndarray, v: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, scores, ids) of a query block on a vector block, by the pruning that each query's
    local threshold asks for."""
    q_len, v_len = np.sqrt((q.astype(np.float64) ** 2).sum(1)), np.sqrt((v.astype(np.float64) ** 2).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(q_len * v_len[0] > 0, least / (q_len * v_len[0]), np.where(least > 0, np.inf, -np.inf))
    reach = cosine <= 1 + 1e-9
    sharp = reach & (cosine >= COORDINATE_FROM)
    lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    dense = list(np.flatnonzero(reach & ~sharp))
    for n in np.flatnonzero(sharp):
        unit = q[n] / q_len[n]
        f = int(np.abs(unit).argmax())
        if f not in lists:
            along = np.divide(v[:, f], v_len, out=np.zeros(len(v)), where=v_len > 0)
            order = np.argsort(along, kind="stable")
            lists[f] = order, along[order]
        order, along = lists[f]
        t, x = min(cosine[n], 1.0), unit[f]
        spread = np.sqrt(max(0.0, (1 - x * x) * (1 - t * t)))
        low = -1.0 if x <= -t else x * t - spread
        high = 1.0 if x >= t else x * t + spread
        a, b = np.searchsorted(along, [low - 1e-9, high + 1e-9])
        if 4 * (b - a) > len(v):
            dense.append(n)
            continue
        at = order[a:b]
        yield n, *_best(_products(q[n : n + 1], v[at])[0], vi[at], qi[n], k, least[n])
    for start in range(0, len(dense), 256):
        part = np.array(dense[start : start + 256])
        with np.errstate(divide="ignore", invalid="ignore"):
            shortest = np.where(q_len[part] > 0, least[part] / q_len[part], -np.inf)
        long_enough = len(v) if (least[part] <= 0).any() else int(np.searchsorted(-v_len, -(shortest.min() * (1 - 1e-9)), side="right"))
        scores = _products(q[part], v[:long_enough])
        for m, n in enumerate(part):
            yield n, *_best(scores[m], vi[:long_enough], qi[n], k, least[n])


def top_products(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` selects, the ``k`` rows with the
    largest inner product of floor(scale * x), ties to the smaller id; fewer where there are fewer.

    Rows whose id is null, or whose vector is null or holds a null or non-finite component, take no
    part. Vectors of different dimensions are never compared; empty vectors score 0 with each other.
    A row is no candidate of its own: of rows that repeat an id, none is a candidate of that id. Sums must fit
    into 64 bits. An empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    fine = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.filter(fine).select(
        F.col(id_col).cast("long").alias("_id"),
        F.transform(F.col(vec_col), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("_v"),
        is_query.alias("_q"),
    )
    square = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    rows = rows.select("_id", "_v", "_q", F.size("_v").alias("_dim"), F.when(square > 0, F.floor(F.log(square) / F.lit(2 * float(np.log(RATIO))))).otherwise(F.lit(-1)).cast("long").alias("_bucket"))
    # Rows by dimension and bucket of length: a bucket is a power of RATIO, so there are at most
    # some 15,000 for all doubles, and a few for real vectors.
    counts = sorted((r["_dim"], -r["_bucket"], r["n"], r["q"] or 0) for r in rows.groupBy("_dim", "_bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_q").cast("long")).alias("q")).collect())
    if not counts:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    first: dict[int, int] = {}
    queries: dict[int, int] = {}
    plan = []
    for dim, bucket, n, q in counts:
        start, blocks = first.get(dim, 0), -(-n // BLOCK)
        plan.append((dim, -bucket, start, blocks))
        first[dim] = start + blocks
        queries[dim] = queries.get(dim, 0) + q
    # A row for each dimension and bucket.
    blocks = spark.createDataFrame(plan, "_dim int, _bucket long, _start long, _blocks long")
    packed = rows.join(F.broadcast(blocks) if len(plan) <= BROADCAST_ROWS else blocks, ["_dim", "_bucket"]).select("_dim", (F.col("_start") + F.pmod(F.xxhash64("_id"), "_blocks")).alias("_at"), "_id", "_v")
    vectors = written(packed.groupBy("_dim", "_at").applyInArrow(_pack, _PACKED), "vector-blocks")
    sizes = spark.createDataFrame([(d, -(-q // QUERIES)) for d, q in queries.items() if q], "_dim int, _qblocks long")
    asked = rows.filter("_q").join(F.broadcast(sizes) if len(queries) <= BROADCAST_ROWS else sizes, "_dim").select("_dim", F.pmod(F.xxhash64("_id"), "_qblocks").alias("_at"), "_id", "_v", "_qblocks")
    named = ["_ids", "_rows", "_width"]
    asked = asked.groupBy("_dim", "_at").applyInArrow(_pack, _PACKED).select("_dim", F.col("_at").alias("_qat"), *[F.col(c).alias(f"_q{c}") for c in named])

    def both(r: dict) -> tuple[np.ndarray, ...]:
        return *_unpack(r["_q_ids"], r["_q_rows"], r["_dim"], r["_q_width"]), *_unpack(r["_ids"], r["_rows"], r["_dim"], r["_width"])

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds to a query block the k-th best score of each of its queries on the longest vectors, and how long a vector
        must be to reach that of any."""
        for batch in batches:
            for r in batch.to_pylist():
                qi, q, vi, v = both(r)
                least = np.full(len(qi), -np.inf)
                for n, s, _ in _search(qi, q, vi, v, least.copy(), k):
                    if len(s) == k:
                        least[n] = s[-1]
                length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
                need = np.divide(least, length, out=np.where(least > 0, np.inf, -np.inf), where=length > 0).min() * (1 - 1e-9)
                need = max(float(need), 0.0) if need > 0 else 0.0
                yield pa.record_batch({**{c: [r[c]] for c in ("_qat", "_q_ids", "_q_rows")}, "_dim": pa.array([r["_dim"]], pa.int32()), "_q_width": pa.array([r["_q_width"]], pa.int32()), "_least": [least.tobytes()], "_need": [need]})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                qi, q, vi, v = both(r)
                found = list(_search(qi, q, vi, v, np.frombuffer(r["_least"]), k))
                if found:
                    yield pa.record_batch({
                        "query_id": np.repeat(qi[[n for n, _, _ in found]], [len(s) for _, s, _ in found]),
                        "_vid": np.concatenate([i for _, _, i in found]),
                        "score": np.concatenate([s for _, s, _ in found]),
                    })

    # The block of the longest vectors is copied once for a few query blocks, so that no task gets them all.
    first_block = vectors.filter("_at = 0").join(sizes, "_dim").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_qblocks") - 1) / SHARED)))).select("_dim", "_copy", *named)
    with_scores = written(
        asked.withColumn("_copy", F.floor(F.col("_qat") / SHARED)).join(first_block, ["_dim", "_copy"]).select("_dim", "_qat", *[f"_q{c}" for c in named], *named).mapInArrow(seed, "_qat long, _q_ids binary, _q_rows binary, _dim int, _q_width int, _least binary, _need double"),
        "query-blocks",
    )
    lengths = vectors.select("_dim", "_at", "_longest")
    pairs = written(with_scores.select("_dim", "_qat", "_need").join(lengths, "_dim").filter(F.col("_longest") >= F.col("_need")).select("_dim", "_qat", "_at"), "block-pairs")
    tries = pairs.join(with_scores, ["_dim", "_qat"]).join(vectors, ["_dim", "_at"]).select("_dim", "_q_ids", "_q_rows", "_q_width", "_least", *named)
    found = tries.mapInArrow(search, "query_id long, _vid long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "_vid"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("_vid").alias(id_col), "score")
