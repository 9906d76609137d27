"""Queries over sections, limits, summaries, choice questions and table maintenance; they join those of the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholion.operators import sections, terms, upkeep
from scholion.plans.material import _LINES
from scholion.plans.registry import SQL, query
from scholion.sources.readers import table

_OPEN = "\n".join(f", last_value(CASE WHEN level = {k} THEN pos END IGNORE NULLS) OVER w AS p{k}, last_value(CASE WHEN level = {k} THEN name END IGNORE NULLS) OVER w AS n{k}" for k in range(1, 7))
_BELOW = ", ".join(f"CASE WHEN p{k} > greatest(-1, {', '.join(f'p{j}' for j in range(1, k))}) THEN n{k} END" for k in range(2, 7))


@query(rf"""WITH t AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS a FROM documents), l AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM t),
    f AS (SELECT *, sum(regexp_matches(line, '^[ \t]*(```|~~~)')::INT) OVER (PARTITION BY doc_id ORDER BY pos) % 2 = 1 AS fenced FROM l),
    h AS (SELECT *, CASE WHEN NOT fenced AND regexp_matches(line, '{sections.HEADING}') THEN length(regexp_extract(line, '{sections.HEADING}', 1)) END AS level, nullif(regexp_extract(line, '{sections.HEADING}', 2), '') AS name FROM f),
    s AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY pos) AS section_seq FROM h), b AS (SELECT doc_id, section_seq, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g') AS content FROM s GROUP BY ALL),
    o AS (SELECT doc_id, section_seq {_OPEN} FROM s WHERE level IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    n AS (SELECT doc_id, section_seq, n1, list_filter([{_BELOW}], lambda x: x IS NOT NULL) AS o FROM o)
    SELECT doc_id, section_seq, left(CASE WHEN len(o) > 0 THEN array_to_string(o[-2:], ' › ') ELSE n1 END, 300) AS section, content FROM b LEFT JOIN n USING (doc_id, section_seq) WHERE content <> ''""")
def markdown_sections(spark, sf):
    return sections.markdown_sections(table(spark, sf, "documents"))


@query(r"""WITH g AS (SELECT source AS doc, count(*) AS pages, sum(CASE WHEN regexp_matches(text, '[^ \t\n\r\f]') THEN length(text) ELSE 0 END)::BIGINT AS chars FROM documents GROUP BY source)
    SELECT *, CASE WHEN pages > 300 THEN 'too_many_pages' WHEN chars = 0 THEN 'no_text' WHEN chars > 200000 THEN 'too_long' END AS error_code FROM g""")
def content_limits(spark, sf):
    return sections.content_limits(table(spark, sf, "documents").withColumnRenamed("source", "doc"), "doc", "text", 300, 200_000)


@query(rf"""WITH {_LINES}, g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM l WHERE length(line) BETWEEN 40 AND 280 AND len(regexp_extract_all(line, '[^ \t\n\r\f]+')) >= 6 AND length(regexp_replace(line, '[^0-9]', '', 'g')) < length(line) * 0.2::DOUBLE),
    j AS (SELECT doc_id, regexp_replace(regexp_replace(string_agg(line, ' ' ORDER BY pos), '[ \t\n\r\f]+', ' ', 'g'), '^ | $', '', 'g') AS s FROM g WHERE r <= 2 GROUP BY doc_id)
    SELECT doc_id, CASE WHEN s IS NULL THEN '' WHEN length(s) <= 280 THEN s ELSE regexp_replace(regexp_replace(substr(s, 1, 280), ' [^ ]*$', ''), '[,.;: ]+$', '') || '…' END AS summary FROM documents LEFT JOIN j USING (doc_id)""")
def section_summaries(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sections.summary(F.col("text")).alias("summary"))


_DEALT = "list_transform(list_sort(list_transform({}, lambda t: md5(doc_id || ':' || lower(term) || ':' || t) || t)), lambda s: substr(s, 33))"
_OTHER = "list_filter(pool, lambda t: NOT contains(lower(term), t) AND NOT contains(t, lower(term)) AND NOT contains(lower(definition), t))"


@query(f"""WITH d AS ({SQL['definitions']}), k AS ({SQL['key_terms']}), p AS (SELECT source, list(term) AS pool FROM k GROUP BY source),
    a AS (SELECT doc_id, term, definition, {_DEALT.format(_OTHER)}[:3] AS wrong FROM d JOIN documents USING (doc_id) JOIN p USING (source))
    SELECT doc_id, term, definition, array_to_string({_DEALT.format('list_append(wrong, lower(term))')}, '|') AS options FROM a WHERE len(wrong) = 3""")
def definition_choices(spark, sf):
    docs = table(spark, sf, "documents")
    defined = terms.definitions(docs).join(docs.select("doc_id", "source"), "doc_id")
    asked = sections.definition_choices(defined, terms.key_terms(docs, "source", 40), "source")
    return asked.withColumn("options", F.array_join("options", "|"))


@query("""WITH n AS (SELECT max(ts) AS now FROM events), s AS (SELECT event_type, ts + INTERVAL 14 DAY <= now OR (event_id % 3 = 0 AND ts < now - INTERVAL 7 DAY) AS dead FROM events, n)
    SELECT event_type, count(*) AS stored, count(*) FILTER (WHERE dead) AS purged FROM s GROUP BY event_type""")
def retention_purge(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.date_trunc("microsecond", "ts"))
    # The clock is one row.
    timed = events.join(F.broadcast(events.agg(F.max("ts").alias("now"))))
    gone = upkeep.dead(F.col("ts") + F.expr("INTERVAL 14 DAY"), F.when(F.col("event_id") % 3 == 0, F.col("ts")), F.col("now"))
    return timed.groupBy("event_type").agg(F.count(F.lit(1)).alias("stored"), F.count_if(gone).alias("purged"))


_ORPHANS = "o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS owner FROM orders), m AS (SELECT l_orderkey AS o_orderkey, max(l_suppkey) AS new FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)"


@query(f"WITH {_ORPHANS} SELECT o_orderkey, coalesce(owner, new) AS owner FROM o LEFT JOIN m USING (o_orderkey)")
def owners_assigned(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey")).alias("owner"))
    named = table(spark, sf, "lineitem").filter("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_suppkey").alias("owner"))
    return upkeep.assign_owners(orders, named, "o_orderkey", "owner")


@query("SELECT c_custkey, coalesce(nullif(trim(CASE c_custkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || s_name || ' ' END), ''), c_name) AS c_name, c_mktsegment FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def partial_updates(spark, sf):
    key = F.col("s_suppkey")
    changes = table(spark, sf, "supplier").select(key.alias("c_custkey"), F.when(key % 4 == 0, "  ").when(key % 4 == 1, F.concat(F.lit(" "), "s_name", F.lit(" "))).alias("c_name"))
    return upkeep.partial_update(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), changes, "c_custkey", ["c_name"])


@query("SELECT DISTINCT lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents s WHERE s.n_chars > 20000 AND s.lang IS NOT DISTINCT FROM d.lang AND s.source IS NOT DISTINCT FROM d.source)")
def missing_scopes(spark, sf):
    docs = table(spark, sf, "documents")
    return upkeep.missing(docs, docs.filter("n_chars > 20000").select("lang", "source").distinct(), ["lang", "source"])


@query("""WITH n AS (SELECT max(ts) AS now FROM events), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 90), s AS (SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN ts END AS revoked_at FROM events)
    SELECT event_id, epoch_us(coalesce(revoked_at, CASE WHEN b.user_id IS NOT NULL THEN now END)) AS revoked_at FROM s LEFT JOIN b USING (user_id), n""")
def sessions_revoked(spark, sf):
    events = table(spark, sf, "events")
    live = events.select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    # The clock is one row.
    timed = live.withColumn("revoked_at", F.when(F.col("event_type") == "purchase", F.col("ts"))).join(F.broadcast(live.agg(F.max("ts").alias("now"))))
    return upkeep.revoke(timed, events.filter("event_type = 'error' AND value > 90"), "user_id", "revoked_at", F.col("now")).select("event_id", "revoked_at")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS s FROM events), g AS (SELECT *, coalesce(s - lag(s) OVER (PARTITION BY user_id ORDER BY s) >= 21600000000, true)::INT AS fresh FROM e),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s RANGE UNBOUNDED PRECEDING) AS run FROM g), p AS (SELECT *, (s - min(s) OVER (PARTITION BY user_id, run)) // 43200000000 AS part FROM r)
    SELECT user_id, min(s) AS started, max(s) AS ended, count(*) AS n FROM p GROUP BY user_id, run, part""")
def idle_sessions(spark, sf):
    return upkeep.idle_sessions(table(spark, sf, "events"), "user_id", "ts", 21_600, 43_200)
