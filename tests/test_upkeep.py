"""Sections, limits, questions and maintenance on small rows with known results."""

from pyspark.sql import functions as F

from scholion.operators import sections, upkeep


def test_markdown_sections(spark):
    text = "before\n# Top\nintro\n## A\n### B\nb\n```\n# no heading\n```\n## C ##\nc\n#tag\n# Next\n"
    rows = sections.markdown_sections(spark.createDataFrame([(1, text), (2, None), (3, " \n")], "doc_id long, text string")).orderBy("section_seq").collect()
    assert [(r["section_seq"], r["section"], r["content"]) for r in rows] == [
        (0, None, "before"), (1, "Top", "# Top\nintro"), (2, "A", "## A"), (3, "A › B", "### B\nb\n```\n# no heading\n```"), (4, "C", "## C ##\nc\n#tag"), (5, "Next", "# Next"),
    ]


def test_content_limits(spark):
    pages = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("b", " "), ("b", None), ("c", "long text")], "doc string, text string")
    got = {r["doc"]: (r["pages"], r["chars"], r["error_code"]) for r in sections.content_limits(pages, "doc", "text", 2, 5).collect()}
    assert got == {"a": (3, 3, "too_many_pages"), "b": (2, 0, "no_text"), "c": (1, 9, "too_long")}


def test_definition_choices(spark):
    defined = spark.createDataFrame([("s", 1, "Gradient", "The direction of steepest slope"), ("t", 2, "Alone", "It has no pool")], "source string, doc_id long, term string, definition string")
    pools = spark.createDataFrame([("s", t) for t in ("gradient", "gradients", "slope", "kernel", "tensor", "matrix", "vector")] + [("t", "kernel")], "source string, term string")
    row, = sections.definition_choices(defined, pools, "source").collect()
    assert len(row["options"]) == 4 and "gradient" in row["options"] and not {"slope", "gradients"} & set(row["options"])


def test_owners_updates_and_missing(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, 7, "b")], "id long, owner long, name string")
    owners = spark.createDataFrame([(1, 9), (2, 9)], "id long, owner long")
    got = lambda df: {r["id"]: r["owner"] for r in df.collect()}
    assert got(upkeep.assign_owners(rows, owners, "id", "owner")) == {1: 9, 2: 7}
    assert got(upkeep.assign_owners(rows, owners, "id", "owner", force=True)) == {1: 9, 2: 9}
    changes = spark.createDataFrame([(1, " "), (2, " c ")], "id long, name string")
    assert {r["id"]: r["name"] for r in upkeep.partial_update(rows, changes, "id", ["name"]).collect()} == {1: "a", 2: "c"}
    wanted = spark.createDataFrame([("a", None), ("a", None), ("b", "x")], "k string, l string")
    assert upkeep.missing(wanted, wanted.filter("k = 'a'"), ["k", "l"]).collect() == [("b", "x")]
    assert upkeep.missing(wanted, wanted.filter("false"), ["k", "l"]).count() == 2


def test_sessions(spark):
    at = [0, 10, 10, 100, 150, 199]
    events = spark.createDataFrame([("u", s) for s in at], "user string, s long").select("user", F.timestamp_seconds("s").alias("ts"))
    got = sorted((r["started"] // 1_000_000, r["ended"] // 1_000_000, r["n"]) for r in upkeep.idle_sessions(events, "user", "ts", 60, 75).collect())
    assert got == [(0, 10, 3), (100, 150, 2), (199, 199, 1)]
    sessions = spark.createDataFrame([("a", None), ("a", 5), ("b", None)], "user string, revoked long")
    users = spark.createDataFrame([("a",), ("a",)], "user string")
    assert sorted(r["revoked"] or 0 for r in upkeep.revoke(sessions, users, "user", "revoked", F.lit(9)).collect()) == [0, 5, 9]
