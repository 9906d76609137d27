"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate, its share of the target divided by its rows. A document's
number of copies is the inverse of the Poisson distribution of that mean at a uniform number hashed
from seed and id: the same on every run and every machine, independent between documents. Each
document is exploded by its count and all copies are dealt and sorted by a hash, a global shuffle.
Sources appear only as a table of rates, so a source that holds a third of all rows meets no other
row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.llm.common import written

#: Up to so many entries of all distributions (16 MB), the table of rates is sent to every task; beyond, it is joined by a
#: shuffle.
BROADCAST_ENTRIES = 2_000_000


def uniform(seed: int, *keys: Column) -> Column:
    """A double in [0, 1) from 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def rates(df: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, power: float = 0.5, total: int | None = None) -> DataFrame:
    """(_source, rate, _cdf): the mean number of copies of a source's rows, and the distribution up to
    where doubles end. Without ``weights`` a source weighs its rows to the ``power``; ``total`` is the
    number of rows to aim at, by default as many as there are. A source without a weight gets no rows."""
    sizes = df.groupBy(F.col(source_col).alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        weighed = sizes.withColumn("_w", F.pow(F.col("_n").cast("double"), F.lit(power)))
    else:
        given = df.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "_s string, _w double")
        weighed = sizes.join(given, F.col("_source").cast("string").eqNullSafe(F.col("_s")), "left").select("_source", "_n", F.coalesce("_w", F.lit(0.0)).alias("_w"))
    sums = weighed.agg(F.sum("_w").alias("_all"), F.sum("_n").alias("_rows"))
    rate = F.round(F.coalesce(F.lit(total).cast("double"), F.col("_rows").cast("double")) * F.col("_w") / F.col("_all") / F.col("_n"), 6)
    # The sums are one row whatever the input.
    rated = weighed.join(F.broadcast(sums)).withColumn("rate", rate).filter("rate > 0").select("_source", "rate")
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 24).cast("int")
    so_far = Window.partitionBy("_source").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    steps = rated.select("_source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("_i")).withColumn("_lf", F.sum(F.log(F.greatest("_i", F.lit(1)).cast("double"))).over(so_far))
    steps = steps.withColumn("_c", F.sum(F.exp(F.col("_i") * F.log("rate") - F.col("rate") - F.col("_lf"))).over(so_far))
    lists = steps.groupBy("_source", "rate").agg(F.array_sort(F.collect_list(F.struct("_i", "_c"))).alias("_l"))
    return lists.select("_source", "rate", F.transform("_l", lambda x: x["_c"]).alias("_cdf"))


def mix(df: DataFrame, seed: int = 17, source_col: str = "source", id_col: str = "doc_id", weights: dict[str, float] | None = None, power: float = 0.5, total: int | None = None) -> DataFrame:
    """The columns of ``df``, ``rate`` and ``copy`` (from 1): each row as often as its Poisson count says,
    in a random order over the whole result. A name that ``df`` already has gets an underscore.

    Rows with a null source are a source of their own; a null id hashes as the empty string, and rows
    that repeat an id all get the same count. An empty table gives no rows.
    """
    names = ["rate", "copy"]
    for n, name in enumerate(names):
        while name in df.columns:
            name += "_"
        names[n] = name
    by_source = written(rates(df, source_col, weights, power, total), "rates")
    if (by_source.agg(F.sum(F.size("_cdf"))).first()[0] or 0) <= BROADCAST_ENTRIES:
        by_source = F.broadcast(by_source)
    # A row travels as one column, so that no name of its columns meets those used here.
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(source_col).alias("_key"), F.col(id_col).alias("_id"), uniform(seed, F.col(id_col)).alias("_u"))
    counted = packed.join(by_source, F.col("_key").eqNullSafe(F.col("_source")))
    # How many values of the distribution are not above u, by its last place among them: a lambda over columns of both sides
    # of the join is pushed to one of them.
    above = F.array_position(F.reverse(F.sort_array(F.array_append("_cdf", F.col("_u")))), F.col("_u")) - 1
    counted = counted.withColumn("_n", (F.size("_cdf") - above).cast("int")).filter("_n > 0")
    copies = counted.select("_row", "_id", "rate", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"))
    dealt = copies.withColumn("_order", F.xxhash64(F.lit(seed), F.col("_id"), F.col("_copy"))).repartition("_order").sortWithinPartitions("_order")
    return dealt.select(*[F.col("_row").getField(c).alias(c) for c in df.columns], F.col("rate").alias(names[0]), F.col("_copy").alias(names[1]))
