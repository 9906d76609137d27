"""The thin queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm import bpe, chat, collocations, exact_dedup, html_extract, jaccard_join, langid, license_scan, lsh_forest, mips, mixing, resampling, suffix_dedup
from scholion.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_topk_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mips.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("places")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_dedup, op2_bpe, op3_jaccard_join, op4_topk_products, op5_mixing, op6_chat, op7_langid, op8_license_scan, op9_suffix_dedup, op10_html_extract, op11_collocations, op12_resampling, op13_lsh_forest)
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _license_sql() -> str:
    places = []
    for kind, t in [*(("base", t) for t in license_scan.BASE), *(("more", t) for t in license_scan.MORE)]:
        key, n = t.key_words, len(t.key_words)
        quoted = "[" + ", ".join(f"'{w}'" for w in key) + "]"
        agree = " + ".join(f"coalesce(list_contains(w[greatest(p - {t.key_at} + {j - t.tolerance}, 0) + 1 : greatest(p - {t.key_at} + {j + t.tolerance} + 1, 0)], '{w}'), false)::INT" for j, w in enumerate(t.words))
        places.append(
            f"SELECT doc_id, '{kind}' AS kind, '{t.label}' AS label, (p - {t.key_at})::BIGINT AS start_at, round(({agree}) / {float(len(t.words))}, 6) AS agree, {t.share} AS share "
            f"FROM (SELECT doc_id, w, pos AS p FROM each JOIN words USING (doc_id) WHERE word = '{key[0]}' AND w[pos + 1 : pos + {n}] = {quoted})"
        )
    return f"""
        WITH words AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{license_scan.WORD}') AS w FROM documents),
        each AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM words),
        places AS (SELECT * FROM ({" UNION ALL ".join(places)}) WHERE agree >= share),
        sums AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'base') AS n_base, min(start_at) FILTER (WHERE kind = 'base') AS first_word, max(start_at) FILTER (WHERE kind = 'base') AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE kind = 'base') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(agree) AS score FROM places GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
        FROM words d LEFT JOIN sums USING (doc_id)"""


def _gathered(table: str) -> str:
    """The words of a table's texts and, of them, single ones and pairs."""
    return f"""SELECT {"doc_id, " if table == "documents" else ""}regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"""


_FEATURES = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))"

# The checksum of the zip format, byte by byte with a table of 256 remainders that eight steps of the polynomial give.
_RESAMPLING = f"""
    WITH rest AS (SELECT list(list_reduce(list_concat([i::BIGINT], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
    docs AS ({_gathered("documents")}), bench AS ({_gathered("benchmark")}),
    have AS (SELECT doc_id, {_FEATURES} AS f FROM docs), wanted AS (SELECT {_FEATURES} AS f FROM bench),
    spelt AS (SELECT f, hex(f) AS x FROM (SELECT f FROM have UNION SELECT f FROM wanted)),
    bytes AS (SELECT f, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS b FROM spelt),
    coded AS (SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, k: xor(c // 256, t[(xor(c, k) % 256) + 1])), 4294967295) % 10000 AS b FROM bytes, rest),
    s AS (SELECT b, count(*) AS s FROM have JOIN coded USING (f) GROUP BY b), t AS (SELECT b, count(*) AS t FROM wanted JOIN coded USING (f) GROUP BY b),
    gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS g FROM s FULL JOIN t USING (b)),
    weighed AS (SELECT doc_id, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM have JOIN coded USING (f) JOIN gain USING (b) GROUP BY doc_id),
    scored AS (SELECT doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM docs LEFT JOIN weighed USING (doc_id)),
    placed AS (SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (WHERE words >= 20) OVER () AS fit FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * fit // 100 THEN place END AS rank FROM placed"""

_COLLOCATIONS = f"""
    WITH said AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM said),
    many AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM pieces, range(1, 5) ms(m), unnest(range(1, len(w) - m + 2)) places(i) WHERE len(w) >= m),
    f AS (SELECT lang, m, phrase, count(*) AS f FROM many GROUP BY ALL), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
    c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
    cut AS (SELECT c.lang, c.phrase, c.f AS a, k, a.f AS l, b.f AS r, (2000000::HUGEINT * c.f) // (a.f + b.f) AS score FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
        JOIN f a ON a.lang = c.lang AND a.m = k AND a.phrase = array_to_string(c.w[1 : k], ' ') JOIN f b ON b.lang = c.lang AND b.m = c.m - k AND b.phrase = array_to_string(c.w[k + 1 : c.m], ' ')),
    best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    held AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, max(f) AS f FROM c, range(2, 4) ks(k), unnest(range(1, m - k + 2)) places(i) WHERE k < m GROUP BY ALL),
    left_over AS (SELECT b.* FROM best b LEFT JOIN held h USING (lang, phrase) WHERE h.f IS NULL OR 100 * h.f < 80 * b.a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


ORACLE_SQL: dict[str, str] = {
    "op11_collocations": _COLLOCATIONS,
    "op12_resampling": _RESAMPLING,
    "op1_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, (count(*) OVER g)::BIGINT AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY norm)""",
    "op4_topk_products": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_mixing": """
        WITH sizes AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY source),
        rates AS (SELECT source, round((SELECT sum(n) FROM sizes)::DOUBLE * w / (SELECT sum(w) FROM sizes) / n, 6) AS rate FROM sizes),
        p AS (SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM rates, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 24)::BIGINT + 1)) AS ks(k)),
        cdf AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p),
        lists AS (SELECT source, any_value(rate) AS rate, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
        u AS (SELECT d.*, rate, cs, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source),
        n AS (SELECT *, len(list_filter(cs, lambda c: c <= u)) AS k FROM u)
        SELECT doc_id, text, lang, source, n_chars, rate, unnest(range(1, k + 1))::INT AS copy FROM n""",
    "op6_chat": """
        WITH said AS (SELECT conv_id, coalesce(floor(turn / 256.0), 0)::BIGINT AS part, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
        speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role <> 'system'),
        pieces AS (SELECT s.conv_id, perspective, part, turn, role, text,
            CASE WHEN role = perspective THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10) ELSE '<|user name=' || regexp_replace(replace(replace(role, '<|', '< |'), '|>', '| >'), '[\r\n]', ' ', 'g') || '|>' || chr(10) END AS h, text || '<|end|>' || chr(10) AS t
            FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
        placed AS (SELECT *, (sum(length(h) + length(t)) OVER (PARTITION BY conv_id, perspective ORDER BY part, turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))::BIGINT AS e FROM pieces)
        SELECT conv_id, perspective, part, count(*)::BIGINT AS n_turns, count(*) FILTER (WHERE role = perspective)::BIGINT AS n_own, string_agg(h || t, '' ORDER BY e) AS text,
            coalesce(string_agg((e - length(t))::VARCHAR || '-' || e::VARCHAR, ',' ORDER BY e) FILTER (WHERE role = perspective), '') AS masks
        FROM placed GROUP BY conv_id, perspective, part""",
    "op8_license_scan": _license_sql(),
}
