"""Streams with state against their batch twins; snapshots that are replayed or broken off."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from scholion.operators import ingest, keyword_index, search, tables, upkeep
from scholion.sources.snapshots import Snapshots
from scholion.streaming import counters, stateful
from scholion.streaming import ingest as streams


def fed(spark, schema, files):
    """A stream of one file a batch, and the folder for its checkpoint."""
    base = tempfile.mkdtemp(prefix="scholion-test-")
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in{n}")
    import shutil
    from pathlib import Path

    Path(f"{base}/in").mkdir()
    for n in range(len(files)):
        for k, f in enumerate(sorted(Path(f"{base}/in{n}").glob("*.parquet"))):
            to = Path(f"{base}/in/{n}-{k}.parquet")
            shutil.copy(f, to)
            import os

            os.utime(to, (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"), f"{base}/checkpoint"


def run(stream, checkpoint, mode="append"):
    got = []
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda rows, _: got.extend(tuple(r) for r in rows.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    states = [o for p in query.recentProgress for o in p["stateOperators"]]
    return got, states[-1]["numRowsTotal"] if states else 0


SCHEMA = "event_id long, user long, t long, ok boolean"
START = 1_700_000_000 // 600 * 600


@pytest.fixture(scope="module")
def hits():
    rng = random.Random(4)
    return [(k, rng.randrange(4), START + 7 * k, rng.random() < 0.3) for k in range(300)]


@pytest.mark.parametrize("ok", [None, "ok"])
def test_limits(spark, hits, ok):
    end = [(900 + k, 99, START + 100_000 + k, True) for k in range(2)]
    stream, checkpoint = fed(spark, SCHEMA, [hits[:90], hits[90:200], hits[200:], end[:1], end[1:]])
    got, left = run(stateful.limited(stream.withColumn("ts", F.timestamp_seconds("t")), "user", "ts", 600, 3, ok, "1 minute"), checkpoint)
    whole = spark.createDataFrame(hits, SCHEMA).withColumn("ts", F.timestamp_seconds("t"))
    if ok is None:
        want = {tuple(r) for r in tables.rate_windows(whole, "user", "ts", 600, 3).select("event_id", "user", "window_start", "n", "refused", "retry_after").collect()}
    else:
        keyed = whole.withColumn("key", F.struct("user", F.floor(F.col("t") / 600).alias("w")))
        n = {r[0]: r[2] for r in tables.failures_since_success(keyed, "key", "ts", ~F.col("ok"), F.col("ok")).collect()}
        want = {(e, u, t // 600 * 600, n[e], n[e] > 3, t // 600 * 600 + 600 - t) for e, u, t, _ in hits}
    assert {g for g in got if g[0] < 900} == want and len(got) == len(hits) + 2
    assert left <= 4  # the last window and its timer


def test_sessions(spark):
    rng = random.Random(6)
    t, rows = START, []
    for k in range(250):
        t += rng.choice([20, 40, 400])
        rows.append((k, rng.randrange(5), t, True))
    late = rows[:80] + rows[100:120], rows[80:100] + rows[120:]  # some a file later, inside the watermark
    end = [(900 + k, 99, t + 50_000 + 10_000 * k, True) for k in range(3)]
    stream, checkpoint = fed(spark, SCHEMA, [*late, *([e] for e in end)])
    got, _ = run(stateful.sessions(stream.withColumn("ts", F.timestamp_seconds("t")), "user", "ts", 300, 900, "2 hours"), checkpoint)
    whole = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("t"))
    want = sorted(tuple(r) for r in upkeep.idle_sessions(whole, "user", "ts", 300, 900).select("user", "started", "ended", "n").collect())
    assert sorted(g for g in got if g[0] != 99) == want


def test_answers(spark):
    rng = random.Random(8)
    schema = "conv_id long, turn long, seq long, token string, done boolean, t long"
    said = {(c, 1): [f"w{c}{k} " for k in range(5 + c)] for c in range(6)}
    events = [(c, turn, k, w, k == len(words) - 1, START + k) for (c, turn), words in said.items() for k, w in enumerate(words)]
    rng.shuffle(events)
    files = [events[:20], events[20:] + events[:10], events[5:15], [(50, 1, 0, "open ", False, START), (50, 1, 2, "end", True, START)]]
    stream, checkpoint = fed(spark, schema, files)
    got, _ = run(stateful.answers(stream.withColumn("ts", F.timestamp_seconds("t")), "ts"), checkpoint)
    assert sorted(got) == sorted((c, turn, "".join(w), len(w)) for (c, turn), w in said.items())


def test_first_uploads(spark):
    schema = "scope string, name string, text string, t long"
    files = [[("a", "1", "x", START), ("a", "2", "x", START + 1), ("b", "3", "x", START)], [("a", "4", "x", START + 5), ("a", "5", "held", START + 6), ("b", "6", "held", START + 6), ("a", "7", None, START)]]
    stream, checkpoint = fed(spark, schema, files)
    held = spark.createDataFrame([("a", "held")], "scope string, text string").withColumn("sha256", F.sha2("text", 256))
    got, _ = run(counters.first_uploads(stream.withColumn("ts", F.timestamp_seconds("t")), "scope", "ts", "text", held).select("scope", "name"), checkpoint)
    assert len(got) == 4 and {g for g in got if g[1] not in "12"} == {("b", "3"), ("b", "6"), ("a", "7")}


def contents(spark, path):
    return {(r["doc_id"], r["content"].split()[0]) for r in Snapshots(spark, path).read("chunks").collect()}


def test_streamed_ingest_is_replayed(spark):
    base = tempfile.mkdtemp(prefix="scholion-test-")
    for n in range(2):
        spark.createDataFrame([(i, f"batch{n} " * 40) for i in range(n, n + 3)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("doc_id long, text string").parquet(f"{base}/in")
        streams.ingested(stream, f"{base}/index", f"{base}/checkpoint").awaitTermination()
    index, want = f"{base}/index", {(0, "batch0"), (1, "batch1"), (2, "batch1"), (3, "batch1")}
    assert contents(spark, index) == want
    version = Snapshots(spark, index).versions()[-1]
    again = spark.createDataFrame([(0, "other " * 40)], "doc_id long, text string")
    assert ingest.ingest_batch(again, index, "ingest", 1) == version and contents(spark, index) == want
    states = {r["doc_id"]: (r["status"], r["signature"]) for r in Snapshots(spark, index).read("states").collect()}
    assert states == {k: ("ready", "hash:features:384") for k in range(4)}
    asked = spark.createDataFrame([(1, "batch1", None), (2, "batch0", None)], "query_id long, query string, scope string")
    found = {(r["query_id"], r["doc_id"]) for r in keyword_index.search_index(spark, index, asked, 9).collect()}
    assert found == {(1, "1:0"), (1, "2:0"), (1, "3:0"), (2, "0:0")}
    assert Snapshots(spark, index).read("vectors").count() == 4


def test_a_swap_that_breaks_off(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="scholion-test-") + "/index"
    first = spark.createDataFrame([(k, f"old{k} " * 30) for k in range(5)], "doc_id long, text string")
    ingest.ingest_batch(first, path)
    before, reader = contents(spark, path), Snapshots(spark, path)
    held = reader.manifest()
    second = spark.createDataFrame([(1, "new " * 30), (7, "seven " * 30), (2, "")], "doc_id long, text string")
    with monkeypatch.context() as broken:
        broken.setattr(Snapshots, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            ingest.ingest_batch(second, path, "s", 0)
    assert contents(spark, path) == before
    ingest.ingest_batch(second, path, "s", 0, owned=spark.createDataFrame([(1,), (2,), (7,)], "doc_id long"))
    assert contents(spark, path) == {(0, "old0"), (1, "new"), (3, "old3"), (4, "old4"), (7, "seven")}
    assert {(r["doc_id"], r["content"].split()[0]) for r in reader.read("chunks", held).collect()} == before  # an old reader
    with pytest.raises(RuntimeError, match="another writer"):
        reader.commit(held, {})
    reader.vacuum(1)
    assert len(reader.versions()) == 1 and (7, "seven") in contents(spark, path)


def test_index_equals_bm25(spark):
    rng = random.Random(3)
    docs = [(k, rng.choice(["a", "b", None]), " ".join(rng.choice("alpha beta gamma delta run running 学 习".split()) for _ in range(rng.randint(0, 30)))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, scope string, text string")
    path = tempfile.mkdtemp(prefix="scholion-test-") + "/index"
    keyword_index.index_documents(spark, path, df.filter("doc_id < 40").withColumn("text", F.lit("replaced later")))
    keyword_index.index_documents(spark, path, df.unionByName(spark.createDataFrame([(700, "a", "alpha")], df.schema)))
    keyword_index.index_documents(spark, path, df.limit(0), removed=spark.createDataFrame([(700,)], "doc_id long"))
    asked = spark.createDataFrame([(1, "alpha runs", "a"), (2, "学习 beta", None), (3, "none of it", "b"), (4, "gamma delta", "zz")], "query_id long, query string, scope string")
    rows = lambda out: sorted(tuple(r) for r in out.select("query_id", "rank", "doc_id", "score").collect())
    for distinct in (False, True):
        assert rows(keyword_index.search_index(spark, path, asked, scoped=False, distinct_len=distinct)) == rows(search.bm25(df, asked, distinct_len=distinct))
    for part in ("a", None, "b", "zz"):  # each scope as if it were all there is
        own = df.filter(F.col("scope").eqNullSafe(F.lit(part)))
        want = rows(search.bm25(own, asked.filter(F.col("scope").eqNullSafe(F.lit(part)))))
        assert [r for r in rows(keyword_index.search_index(spark, path, asked)) if r[0] in {q["query_id"] for q in asked.collect() if q["scope"] == part}] == want
    allowed = spark.createDataFrame([(1, d) for d in range(0, 60, 2)] + [(2, 900)], "query_id long, doc_id long")
    got = rows(keyword_index.search_index(spark, path, asked, allowed=allowed))
    want = rows(search.bm25(df.filter("scope = 'a' and doc_id % 2 = 0"), asked.filter("query_id = 1")))
    assert [r for r in got if r[0] == 1] == want and not [r for r in got if r[0] == 2]
