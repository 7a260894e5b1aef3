"""The queries of this subpackage: each numbered operator over its whole table, and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_WORD, TOKENIZER_BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_codec import digests

    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer(TOKENIZER_WORD))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, tokenizer(TOKENIZER_BYTE), limit=512)


#: Shares of all tokens that each label class (quality, toxic) is to have.
TARGETS = {"q1t0": 0.80, "q1t1": 0.05, "q0t0": 0.12, "q0t1": 0.03}


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and the domain that its labels name."""
    return labels.select("doc_id", F.concat(F.lit("q"), "quality", F.lit("t"), "toxic").alias("domain"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_rates

    return mix_rates(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), TARGETS)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import transcript_query

    return transcript_query(table(spark, sf_dir, "conversations"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cut=0.3)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "template", "learned")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .top_k import top_k

    return top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive

    return archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"), least=10, ranks=10)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are those of base spans; ``spans`` has them and what the model adds."""
    from .pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where it does not fit a long."""
    from .whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"), most=32, scale=64).withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_chat_format": op2_chat_format,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_simhash": op4_simhash,
    "op5_quality": op5_quality,
    "op6_url_filter": op6_url_filter,
    "op7_top_k": op7_top_k,
    "op8_token_counts": op8_token_counts,
    "op9_warc": op9_warc,
    "op10_neighbours": op10_neighbours,
    "op11_divergence": op11_divergence,
    "op12_pii": op12_pii,
    "op13_whitening": op13_whitening,
}

#: DuckDB texts, for the operators whose whole result SQL can express.
ORACLES: dict[str, str] = {
    "op7_top_k": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1]::HUGEINT * z[2])), 0) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
    """,
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY 1),
        r AS (
            SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND (page_id IS NULL OR page_id > first) AS again
            FROM d JOIN f USING (payload_digest))
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN first END AS refers_to
        FROM r
    """,
    "op11_divergence": r"""
        WITH d AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
        words AS (
            SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x{0}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS w FROM d),
        lower_words AS (SELECT r, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM words),
        kept AS (SELECT lang, term FROM lower_words GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
        counts AS (SELECT lang, source, term, count(*) AS c FROM lower_words JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
        groups AS (SELECT DISTINCT lang, source FROM d),
        v AS (SELECT g.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN kept k USING (lang) GROUP BY 1),
        n AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY 1, 2),
        p AS (
            SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 2)::HUGEINT) // (n + 2 * v) AS p
            FROM n JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
        q AS (
            SELECT lang, term, 1 + (1000000000 * (sum(c) + 2)::HUGEINT) // (any_value(total) + 2 * any_value(v)) AS q
            FROM counts JOIN (SELECT lang, sum(n) AS total FROM n GROUP BY 1) USING (lang) JOIN v USING (lang) GROUP BY 1, 2),
        pairs AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(s, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (
                SELECT x.lang, x.source, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS s
                FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) f
              ON f.lang = a.lang AND f.source = a.source AND f.other = b.source),
        terms AS (
            SELECT p.lang, p.source, p.term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
        ranked AS (
            SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
            UNION ALL
            SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
}
