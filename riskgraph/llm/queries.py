"""The driver's queries over the corpus tables, and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.llm import conversation_trie, divergence, html_extract, license_scan, lm_score, media, mixing, near_dedup, quality, sentencepiece_codec, suffix_dedup, token_counts, topk_search


MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text is empty, a null id comes after all others, repeated rows stay; other columns are ignored; an empty table gives no rows."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty page has an empty text, repeated rows stay; other columns are ignored; an empty table gives no rows."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty and alike, null ids come last, repeated rows are of one class; see ``near_dedup.classes``."""
    return near_dedup.classes(table(spark, sf_dir, "documents")).drop("row")


#: Target weights of languages; sources, other languages and topics are tempered.
LANGUAGES = {"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts, sources, languages and ids, repeated rows and extra columns: see ``mixing.mix``."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), weights=LANGUAGES)
    return mixed.drop("text").withColumnsRenamed({"mix_tokens": "n_tokens", "mix_topic": "topic", "mix_weight": "weight", "mix_probability": "probability", "mix_gap": "gap", "mix_kept": "kept"})


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a null id or an unusable vector take no part; of queries with one id the smallest vector asks, repeated candidates each count; no rows from an empty table."""
    vectors = topk_search.quantised(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty text has no tokens, score 0 and no ``per_token``; repeated rows and null ids stay and count; see ``lm_score.score``."""
    return lm_score.score(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = MODEL_PATH) -> DataFrame:
    """A null or empty text has no ids, repeated rows and null ids stay; other columns are ignored; an empty table gives no rows."""
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), sentencepiece_codec.Model.load(model_path))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty text has the score of no features, repeated rows are scored each, null ids aren't held out; without labels all scores are 0.5."""
    scored = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents have no paths, so source, language and id make up a tree of files: every fourth id is a notice
    beside the folders of its source and language, and the others lie in those folders. See ``license_scan`` for nulls, repeats and empty tables."""
    docs = table(spark, sf_dir, "documents")
    top = (F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    path = F.when(F.col("doc_id") % 4 == 0, F.concat_ws("/", *top, F.concat(F.lit("NOTICE-"), name))).otherwise(F.concat_ws("/", *top, (F.col("doc_id") % 64).cast("string"), name))
    return license_scan.inherit(license_scan.scan(docs.select("doc_id", "text", path.alias("path"))))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text is empty (one row of spaces), repeated rows and null ids stay; other columns are ignored; an empty table gives no rows.

    The NPY tile itself is the operator's; here its digest stands for it.
    """
    made = media.media_columns(table(spark, sf_dir, "documents"))
    return made.withColumn("tile_sha256", F.sha2("tile", 256)).drop("tile")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text, lang and source are '', repeated rows count each, groups and languages without terms have pairs of value 0; no rows from an empty table."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """A null or empty text has no tokens, repeated rows and null ids stay; other columns are ignored; an empty table gives no rows."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without conv_id take no part, null turns come first, null roles and texts are empty, repeated turns all stay; no rows from an empty table."""
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup, "op2_html_extraction": op2_html_extraction, "op3_near_dedup": op3_near_dedup, "op4_mixing": op4_mixing, "op5_exact_top_k": op5_exact_top_k, "op6_lm_score": op6_lm_score, "op7_sentencepiece": op7_sentencepiece, "op8_quality_classifier": op8_quality_classifier, "op9_license_scan": op9_license_scan, "op10_media_columns": op10_media_columns, "op11_source_divergence": op11_source_divergence, "op12_token_counts": op12_token_counts, "op13_conversation_trie": op13_conversation_trie}
ORACLES: dict[str, str] = {
    "op5_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
            WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op6_lm_score": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f]+') AS ws FROM documents
        ), t AS (
            SELECT doc_id, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)
        ), u AS (SELECT w, count(*) AS c FROM t GROUP BY w),
        b AS (SELECT v, w, count(*) AS c FROM t WHERE v IS NOT NULL GROUP BY v, w HAVING count(*) >= 2),
        total AS (SELECT CAST(round(1e6 * ln(count(*))) AS BIGINT) AS l FROM t),
        s AS (
            SELECT doc_id, CASE
                WHEN t.v IS NULL THEN CAST(round(1e6 * ln(u.c)) AS BIGINT) - total.l
                WHEN b.c IS NOT NULL THEN CAST(round(1e6 * ln(b.c)) AS BIGINT) - CAST(round(1e6 * ln(uv.c)) AS BIGINT)
                ELSE CAST(round(1e6 * ln(0.4)) AS BIGINT) + CAST(round(1e6 * ln(u.c)) AS BIGINT) - total.l END AS l
            FROM t CROSS JOIN total JOIN u ON u.w = t.w LEFT JOIN u uv ON uv.w = t.v LEFT JOIN b ON b.v = t.v AND b.w = t.w
        ), g AS (SELECT doc_id, count(*) AS n, sum(l) AS s FROM s GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens, CAST(coalesce(s, 0) AS BIGINT) AS score,
               CASE WHEN n > 0 THEN CAST(s AS DOUBLE) / CAST(n AS DOUBLE) / 1e6 END AS per_token
        FROM d LEFT JOIN g ON g.doc_id = d.doc_id
    """,
    "op11_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
            FROM documents
        ), c AS (
            SELECT row_id, lang, source, term, count(*) AS n FROM (SELECT row_id, lang, source, unnest(ws) AS term FROM d) GROUP BY ALL
        ), k AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS all_n FROM c GROUP BY lang, term HAVING count(*) >= 3),
        v AS (SELECT lang, count(*) AS v, sum(all_n) AS lang_total FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        own AS (SELECT c.lang, c.source, c.term, CAST(sum(c.n) AS HUGEINT) AS n FROM c JOIN k ON k.lang = c.lang AND k.term = c.term GROUP BY ALL),
        total AS (SELECT lang, source, sum(n) AS total FROM own GROUP BY ALL),
        p AS (
            SELECT g.lang, g.source, k.term, coalesce(own.n, 0) AS n,
                   1 + (1000000000 * (coalesce(own.n, 0) + 1)) // (coalesce(total.total, 0) + v.v) AS p,
                   1 + (1000000000 * (k.all_n + 1)) // (v.lang_total + v.v) AS q
            FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang
            LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = k.term
            LEFT JOIN total ON total.lang = g.lang AND total.source = g.source
        ), s AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
            FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
        ), r AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
            FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
    "op13_conversation_trie": """
        WITH c AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
            FROM conversations WHERE conv_id IS NOT NULL
        ), h AS (
            SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
                list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
                lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 9 AS h
            FROM (SELECT DISTINCT conv_id FROM c)
        ), r AS (
            SELECT h.conv_id, 0 AS own, c.pos, c.role, c.text FROM h JOIN c ON c.conv_id = h.base AND c.pos <= h.h
            UNION ALL
            SELECT h.conv_id, 1, c.pos, c.role, c.text FROM h JOIN c ON c.conv_id = h.conv_id AND c.pos > h.h
        ), t AS (
            SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS d,
                   sha256(concat(octet_length(encode(role)), ':', role, text)) AS turn FROM r
        ), paths AS (
            SELECT conv_id, d, text, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS path FROM t
            UNION ALL SELECT conv_id, 0, '', '' FROM h
        ), n AS (
            SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(octet_length(encode(text))) AS saves FROM paths GROUP BY path, d
        ), up AS (
            SELECT n.path, p.conv_id AS parent_conv_id FROM n JOIN n p ON n.d > 0 AND p.path = n.path[:64 * (n.d - 1)]
        ), kids AS (
            SELECT p.path, count(n.path) AS n_children FROM n p LEFT JOIN n ON n.d = p.d + 1 AND n.path[:64 * p.d] = p.path GROUP BY p.path
        ), sub AS (
            SELECT a.path, sum(n.saves) AS saved_tokens, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
            FROM n JOIN kids k ON k.path = n.path JOIN paths a ON a.conv_id = n.conv_id AND a.d <= n.d GROUP BY a.path
        ), ends AS (
            SELECT p.path, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids
            FROM paths p JOIN (SELECT conv_id, max(d) AS d FROM paths GROUP BY conv_id) m ON m.conv_id = p.conv_id AND m.d = p.d GROUP BY p.path
        )
        SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.parent_conv_id, n.n_convs, kids.n_children, CAST(sub.n_leaves AS BIGINT) AS n_leaves,
               CAST(sub.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
        FROM n JOIN kids ON kids.path = n.path JOIN sub ON sub.path = n.path LEFT JOIN up ON up.path = n.path LEFT JOIN ends ON ends.path = n.path
    """,
}
