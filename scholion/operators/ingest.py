"""From stored documents to a searchable index: states, sections of pages, paragraphs and slides, and the swap of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholion.functions.formats import reflow, xml_attribute, xml_text
from scholion.functions.text import SPACE, clean_whitespace, first_line_heading
from scholion.operators.chunks import chunk
from scholion.operators.keyword_index import keyword_tables
from scholion.operators.search import embedding_provider
from scholion.sources.scratch import stored
from scholion.sources.snapshots import Snapshots


def text_files(spark: SparkSession, folder: str, suffixes: str = "{md,markdown,txt}") -> DataFrame:
    """(path, text) of the files of a folder with one of the suffixes, whatever their encoding; empty files give no row."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffixes}").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", decoded(F.col("content")).alias("text"))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8, with or without its mark; UTF-16 by its mark; else Latin-1, which every byte has a place in."""
    utf8 = F.try_validate_utf8(F.when(F.substring(content, 1, 3) == F.lit(b"\xef\xbb\xbf"), F.substring(content, 4, 1 << 30)).otherwise(content).cast("string"))
    marked = F.substring(content, 1, 2).isin(F.lit(b"\xff\xfe"), F.lit(b"\xfe\xff"))
    return F.when(marked, F.decode(content, "UTF-16")).otherwise(F.coalesce(utf8, F.decode(content, "ISO-8859-1")))


def page_sections(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, page, section, content): pages cleaned and re-flowed, with their first line as heading; empty ones are left out."""
    made = pages.select(doc, page, reflow(clean_whitespace(F.coalesce(F.col(text), F.lit("")))).alias("content"))
    # Behind a generator, the filter does not run the re-flow a second time.
    made = made.select(doc, page, F.explode(F.array("content")).alias("content"))
    return made.filter("content <> ''").select(doc, page, first_line_heading(F.col("content")).alias("section"), "content")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}+|{SPACE}+$", "")


def paragraph_sections(paragraphs: DataFrame, doc: str, seq: str, style: str, text: str) -> DataFrame:
    """(doc, section_seq, section, content): paragraphs cut before each heading or title, which is the first line too."""
    rows = paragraphs.select(doc, seq, _stripped(F.col(text)).alias("_t"), F.coalesce(F.lower(style).startswith("heading") | (F.lower(style) == "title"), F.lit(False)).alias("_h")).filter("_t <> ''")
    so_far = Window.partitionBy(doc).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section_seq", F.sum(F.col("_h").cast("long")).over(so_far))
    made = rows.groupBy(doc, "section_seq").agg(F.array_sort(F.collect_list(F.struct(seq, "_t"))).alias("_l"), F.max(F.when(F.col("_h"), F.left("_t", F.lit(300)))).alias("section"))
    return made.select(doc, "section_seq", "section", clean_whitespace(F.array_join(F.transform("_l", lambda x: x["_t"]), "\n")).alias("content")).filter("content <> ''")


def slide_sections(shapes: DataFrame, doc: str, slide: str, order: str, kind: str, level: str, text: str) -> DataFrame:
    """(doc, slide, section, content): a slide's title, its lines by level, rows of tables, and at last its notes."""
    said = _stripped(F.col(text))
    line = F.when(F.col(kind) == "notes", F.concat(F.lit("Speaker notes: "), said)).when((F.col(kind) == "text") & (F.col(level) > 0), F.concat(F.repeat(F.lit("  "), F.col(level).cast("int")), F.lit("- "), said)).otherwise(said)
    rank = F.when(F.col(kind) == "title", 0).when(F.col(kind) == "notes", 2).otherwise(1)
    rows = shapes.filter(said != "").select(doc, slide, rank.alias("_r"), F.col(order).alias("_o"), line.alias("_l"), F.when(F.col(kind) == "title", said).alias("_t"))
    made = rows.groupBy(doc, slide).agg(F.array_sort(F.collect_list(F.struct("_r", "_o", "_l"))).alias("_x"), F.max("_t").alias("section"))
    return made.select(doc, slide, "section", clean_whitespace(F.array_join(F.transform("_x", lambda x: x["_l"]), "\n")).alias("content")).filter("content <> ''")


def ingest(docs: DataFrame, id_col: str = "doc_id", text: str = "text", most_chars: int = 2_000_000, size: int = 1000, overlap: int = 150) -> tuple[DataFrame, DataFrame]:
    """(states, chunks) of documents: ``states`` are (id, status, error, chunks, chars), ready or failed each on its own;
    only the chunks of ready ones are given."""
    length = F.length(_stripped(F.col(text)))
    errors = docs.select(id_col, F.when(length == 0, "no_text").when(length > most_chars, "too_long").alias("_error"), F.coalesce(F.length(text), F.lit(0)).alias("chars"))
    made = chunk(docs.filter(length.between(1, most_chars)), size, overlap, id_col, text)
    counts = made.groupBy(F.col(id_col).alias("_i")).agg(F.count(F.lit(1)).alias("_n"))
    found = errors.join(counts, F.col(id_col) == F.col("_i"), "left").withColumn("chunks", F.coalesce("_n", F.lit(0)))
    error = F.coalesce("_error", F.when(F.col("chunks") == 0, "no_chunks"))
    return found.select(id_col, F.when(error.isNull(), "ready").otherwise("failed").alias("status"), error.alias("error"), "chunks", "chars"), made


def interrupted(states: DataFrame) -> DataFrame:
    """States after a restart: what was pending or in process has failed."""
    lost = F.col("status").isin("pending", "processing")
    return states.withColumn("error", F.when(lost, "interrupted").otherwise(F.col("error"))).withColumn("status", F.when(lost, "failed").otherwise(F.col("status")))


def to_reindex(states: DataFrame, signature: Column, current: Column) -> DataFrame:
    """The documents to process again, and whether they need it: all but those in process."""
    return states.filter("status <> 'processing'").withColumn("needs_reindex", (F.col("status") == "ready") & ~signature.eqNullSafe(current))


def swap_chunks(chunks: DataFrame, replaced: DataFrame, path: str, id_col: str = "doc_id") -> int:
    """Replaces the chunks of the ``replaced`` documents (id) in the index at ``path`` by ``chunks``, all at once, and gives the
    index's new version; buckets that hold none of these documents are not touched."""
    index = Snapshots(chunks.sparkSession, path)
    before = index.manifest()
    return index.commit(before, index.written(before, "chunks", chunks, replaced, id_col))


def ingest_batch(docs: DataFrame, path: str, stream: str | None = None, batch: int | None = None, provider: str = "hash", signature: str = "hash:features:384", owned: DataFrame | None = None) -> int:
    """Takes documents (doc_id, text; scope, which may be left out) into the index at ``path``: states, chunks, their vectors and their postings change in
    one version, or none of them does. Gives the version; a batch of a stream that went in already changes nothing.

    Of several rows of an id the greatest text counts. Only documents that are still ``owned`` (doc_id) when the work begins are
    looked at. Chunks are named ``doc_id:chunk_index``; a document that fails loses those it had."""
    spark = docs.sparkSession
    index = Snapshots(spark, path)
    before = index.manifest()
    if stream is not None and before["batches"].get(stream, -1) >= batch:
        return before["version"]
    docs = docs if "scope" in docs.columns else docs.withColumn("scope", F.lit(None).cast("string"))
    docs = docs if owned is None else docs.join(owned.select("doc_id").distinct(), "doc_id", "left_semi")
    once = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), "scope")).alias("d"))
    once = stored(once.select("doc_id", "d.scope", "d.text"), "documents")
    states, chunks = ingest(once)
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))
    chunks = stored(chunks.join(once.select("doc_id", "scope"), "doc_id").select(name.alias("chunk_id"), "doc_id", "scope", "chunk_index", "content", "char_count"), "chunks")
    states = states.withColumn("signature", F.when(F.col("status") == "ready", signature))
    vectors = embedding_provider(provider)(chunks, id_col="chunk_id", text="content").withColumnRenamed("id", "chunk_id").join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    ids = once.select("doc_id")
    gone = chunks.select(F.col("chunk_id").alias("doc_id"))
    if "chunks" in before["tables"]:
        gone = gone.unionByName(index.read("chunks", before).join(ids, "doc_id", "left_semi").select(F.col("chunk_id").alias("doc_id")))
    tables = index.written(before, "states", states, ids, "doc_id") | index.written(before, "chunks", chunks, ids, "doc_id") | index.written(before, "vectors", vectors, ids, "doc_id")
    tables |= keyword_tables(index, before, chunks.select(F.col("chunk_id").alias("doc_id"), "scope", F.col("content").alias("text")), gone)
    return index.commit(before, tables, stream, batch)


def source_block(index: Column, name: Column, section: Column, content: Column) -> Column:
    """One source of a prompt: quoted material with its number, file and section."""
    named = F.when(section.isNotNull(), F.concat(F.lit(" section="), xml_attribute(section))).otherwise("")
    return F.concat(F.lit("<source id="), xml_attribute(index.cast("string")), F.lit(" file="), xml_attribute(name), named, F.lit(">\n"), xml_text(content), F.lit("\n</source>"))


#: What is said about weak sources and about none.
WEAK = "Retrieval note: these excerpts are only weakly related to the question. If they do not answer it, say that the course materials don't cover it instead of answering from general knowledge."
NONE = "No relevant excerpts were found in the course materials for this question."


def question_messages(sources: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """(key, message): the sources (key, index, block) of each question (key, question, weak) in order, a note if they are
    weak, and the question; without any source, the text for that."""
    blocks = sources.groupBy(F.col(key).alias("_k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "block"))), lambda x: x["block"]), "\n").alias("_b"))
    head = F.when(F.col("_b").isNull(), NONE).otherwise(F.concat(F.lit("<sources>\n"), F.col("_b"), F.lit("\n</sources>"), F.when(F.col("weak"), "\n\n" + WEAK).otherwise("")))
    return questions.join(blocks, F.col(key) == F.col("_k"), "left").select(key, F.concat(head, F.lit("\n\nQuestion: "), F.col("question")).alias("message"))
