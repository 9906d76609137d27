"""Files, formats, ingest with its index, and the streams with state."""

import random
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from scholion.functions import formats
from scholion.operators import ingest, study
from scholion.sources.snapshots import Snapshots
from scholion.streaming import ingest as streams


def column(spark, expression, values, kind="string"):
    return [r["o"] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").coalesce(1).select(expression(F.col("x")).alias("o")).collect()]


def test_files_of_any_encoding(spark):
    folder = Path(tempfile.mkdtemp(prefix="scholion-test-"))
    text = "Grüße, 学习 – ok"
    files = {"a.md": text.encode(), "b.txt": b"\xef\xbb\xbf" + text.encode(), "c.txt": text.encode("utf-16"), "d.txt": "Grüße".encode("latin-1"), "e.pdf": b"x", "f.markdown": b""}
    for name, data in files.items():
        (folder / name).write_bytes(data)
    got = {Path(r["path"]).name: r["text"] for r in ingest.text_files(spark, str(folder)).collect()}
    assert got == {"a.md": text, "b.txt": text, "c.txt": text, "d.txt": "Grüße"}


def test_reflow_and_formats(spark):
    pages = ["Graph search\nvisits nodes in\norder, and\nThen stops.\n- item\n- next", "one\n\ntwo", None, "", "x" * 61 + "\nUpper goes on", "x" * 61 + ".\nUpper stands"]
    assert column(spark, formats.reflow, pages) == ["Graph search visits nodes in order, and\nThen stops.\n- item\n- next", "one\n\ntwo", None, "", "x" * 61 + " Upper goes on", "x" * 61 + ".\nUpper stands"]
    assert column(spark, formats.human_bytes, [0, 1023, 1536, 5 << 20], "long") == ["0 B", "1023 B", "2 KB", "5.0 MB"]
    assert column(spark, formats.human_interval, [0.0069, 0.5, 3.0, 45.0, 800.0], "double") == ["10m", "12h", "3d", "2mo", "2.2y"]
    assert column(spark, lambda x: formats.linked_citations(x, F.lit(3)), ["a [1, 3] b", "[4]", "```\n[1]\n``` [2]", "[1](u) [99999999999]", None]) == ["a [1](#cite-1)[3](#cite-3) b", "[4]", "```\n[1]\n``` [2](#cite-2)", "[1](u) [99999999999]", None]
    assert column(spark, formats.json_object, ['{"a": 1}', '```json\n{"a": 1}\n```', 'So: {"a": {"b": 2}} done', "none", "{broken", None]) == ['{"a": 1}', '{"a": 1}', '{"a": {"b": 2}}', None, None, None]
    assert [tuple(map(tuple, v)) for v in column(spark, formats.term_frequencies, ["'o''neill':1,5A 'tree':2", ""])] == [(("o'neill", 2), ("tree", 1)), ()]
    assert column(spark, formats.xml_attribute, ['a "b" <c>', "it's"]) == ["'a \"b\" &lt;c&gt;'", "\"it's\""]
    assert column(spark, formats.document_title, ["week_1.intro.pdf", "notes", ".hidden"]) == ["week 1.intro", "notes", ".hidden"]


def test_index_is_swapped_by_document(spark):
    path = tempfile.mkdtemp(prefix="scholion-test-") + "/index"
    words = lambda i, n: " ".join(f"word{i} number{k}" for k in range(n))
    docs = spark.createDataFrame([(i, words(i, 300)) for i in range(40)] + [(90, ""), (91, "short"), (92, None)], "doc_id long, text string")
    states, chunks = ingest.ingest(docs)
    found = {r["doc_id"]: (r["status"], r["error"]) for r in states.collect()}
    assert found[3] == ("ready", None) and found[90] == found[92] == ("failed", "no_text") and found[91] == ("failed", "no_chunks")
    ingest.swap_chunks(chunks, docs.select("doc_id"), path)
    before = {tuple(r) for r in Snapshots(spark, path).read("chunks").select("doc_id", "chunk_index", "content").collect()}
    again = spark.createDataFrame([(3, words(77, 50)), (4, "")], "doc_id long, text string")
    ingest.swap_chunks(ingest.ingest(again)[1], again.select("doc_id"), path)
    after = {tuple(r) for r in Snapshots(spark, path).read("chunks").select("doc_id", "chunk_index", "content").collect()}
    assert {r for r in after if r[0] not in (3, 4)} == {r for r in before if r[0] not in (3, 4)}
    assert not any(r[0] == 4 for r in after) and {r[2].split()[0] for r in after if r[0] == 3} == {"word77"}
    left = ingest.interrupted(spark.createDataFrame([(1, "processing", None), (2, "ready", None)], "doc_id long, status string, error string"))
    assert {tuple(r) for r in left.collect()} == {(1, "failed", "interrupted"), (2, "ready", None)}
    marked = ingest.to_reindex(spark.createDataFrame([(1, "ready", "a"), (2, "ready", None), (3, "processing", "b"), (4, "ready", "b")], "doc_id long, status string, s string"), F.col("s"), F.lit("b"))
    assert {(r["doc_id"], r["needs_reindex"]) for r in marked.collect()} == {(1, True), (2, True), (4, False)}


def test_streamed_states(spark):
    rng, base = random.Random(2), tempfile.mkdtemp(prefix="scholion-test-")
    rows = [(rng.randrange(5), 1_700_000_000 + 60 * k, rng.choice(["again", "hard", "good", "easy", "other"])) for k in range(120)]
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], "card long, t long, rating string").coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema("card long, t long, rating string").option("maxFilesPerTrigger", 1).parquet(f"{base}/in").withColumn("ts", F.timestamp_seconds("t"))
    last = {}

    def keep(batch, _):
        last.update({r[0]: tuple(r)[1:] for r in batch.collect()})

    streams.card_states(stream.select("card", "ts", "rating")).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start().awaitTermination()
    whole = spark.createDataFrame(rows, "card long, t long, rating string").withColumn("ts", F.timestamp_seconds("t"))
    want = {r["card"]: (r["ease"], r["interval_days"], r["repetitions"], r["lapses"], r["reviews"]) for r in study.fold_reviews(whole, ["card"]).collect()}
    assert last == want
