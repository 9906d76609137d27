"""What the operators of this subpackage share: reading, lower-casing, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.functions.batches import slices  # noqa: F401 (operators take it from here)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is the fast path: on pure ASCII it does exactly that, and the two lengths tell
    which texts are pure ASCII.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, ascii_uppercase, ascii_lowercase)
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's checkpoint directory, or, where the
    session names none and runs on one machine (a test), a fresh temporary one. A cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="scholion-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut, safe against lost
    executors, and compressed, unlike a checkpoint of rows."""
    path = f"{shared_dir(df.sparkSession)}/scholion-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that an operator writes on its way; ``clear`` deletes those written so far, once nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/scholion-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths = []


_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = 1 << 20


def word_hashes(text: bytes) -> np.ndarray:
    """64 bits of a hash of each word (`[^\\x20\\x09-\\x0D]+`) after lower-casing A-Z, of any length; words of a long text are
    split off block by block."""
    out, start = [], 0
    while start < len(text):
        end = start + _STEP
        while end < len(text) and text[end] != 32 and not 9 <= text[end] <= 13:
            end += 1
        words = text[start:end].translate(_FOLD).split()
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        start = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every other."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_PLACE = np.random.default_rng(20240601).integers(0, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """The sorted distinct hashes (int64) of a text's shingles of ``n`` words; one of all words if there are fewer."""
    words = word_hashes(text)
    if not len(words):
        return np.zeros(0, np.int64)
    n = min(n, len(words))
    count = len(words) - n + 1
    total = np.full(count, n, np.uint64)
    for j in range(n):
        total += mix(words[j : j + count] * _PLACE[j])
    return np.unique(mix(total).view(np.int64))


@contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Arrow batches of about ``most`` bytes for what is planned and run inside, so that neither side of the pipe to a
    Python worker holds thousands of whole texts at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, f"{most}b")
    try:
        yield
    finally:
        spark.conf.set(key, before)
