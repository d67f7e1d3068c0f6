"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, embedding_dedup, html_text, minhash, ppm, quality, secrets, token_files, warc
from .common import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links(table(spark, sf_dir, "embeddings"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return token_files.round_trip(table(spark, sf_dir, "documents"), f.read())


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_html_text, op2_warc, op3_decontamination, op4_byte_bpe, op5_embedding_dedup, op6_token_files, op7_ppm, op8_secrets, op9_quality, op10_minhash, pipeline)}

# SHA-1 and the rule for revisits, and links above an exact threshold with what they reach, can be said in SQL; automata, models and templates of the other operators can't.
# The SQL of op5 and op10 compares all pairs that share a label or a shingle: seconds at sf0.01, too slow at larger sizes.
ORACLE_SQL = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
        g AS (SELECT d, max(page_id) AS m FROM p WHERE octet_length(encode(h)) >= 1000 GROUP BY d)
        SELECT p.page_id AS page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN p.page_id < g.m THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN p.page_id < g.m THEN g.m END AS refers_to
        FROM p LEFT JOIN g ON p.d = g.d
    """,
    "op5_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])
        ),
        pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least_id AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN least_id ON vec_id = least_id.a LEFT JOIN degree ON vec_id = degree.a
    """,
    "op10_minhash": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct([array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)])
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END AS s
            FROM words
        ),
        sized AS (SELECT doc_id, coalesce(len(s), 0) AS n, s FROM sets),
        opened AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
        pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM opened a JOIN opened b ON a.g = b.g AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ),
        links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM sized UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least_id AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN least_id ON doc_id = a
    """,
}
