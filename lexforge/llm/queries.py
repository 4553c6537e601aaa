"""The queries of this folder, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), limit=SHARD_LIMIT)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=2048)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"), least=50)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), n=4, threshold=Fraction(85, 100))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"), least=0)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op5_mixing: sizes and targets."""
    from pyspark.sql import functions as F

    return op5_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9_fingerprints: lengths and edited texts."""
    return op9_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


#: Bytes of text of a shard.
SHARD_LIMIT = 4 << 20


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_sentencepiece, op2_sharding, op3_token_counts, op4_suffix_dedup, op5_mixing, op6_embedding_dedup, op7_ngram_jaccard, op8_warc, op9_fingerprints, op10_toxicity, mix_targets, edited_texts)
    return {f.__name__: f for f in every}


#: A shard is the shortest prefix of the hash whose documents fit, all of whose own prefixes do not.
_OP2_SQL = f"""
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
                  CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 14)) AS BIGINT) AS h FROM documents),
     p AS (SELECT doc_id, n_bytes, k AS depth, h >> (56 - k) AS prefix FROM d, range(0, 57) AS r(k)),
     s AS (SELECT depth, prefix, sum(n_bytes) AS b, count(*) AS n FROM p GROUP BY ALL),
     f AS (SELECT p.doc_id, p.n_bytes, p.depth, p.prefix, s.b, s.n,
                  row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) AS r
           FROM p JOIN s USING (depth, prefix) WHERE s.b <= {SHARD_LIMIT} OR depth = 56)
SELECT doc_id, n_bytes, CAST(prefix AS BIGINT) AS shard_prefix, CAST(depth AS INTEGER) AS shard_depth,
       CAST(b AS BIGINT) AS shard_bytes, CAST(n AS BIGINT) AS shard_rows
FROM f WHERE r = 1
"""

#: Base32 of the SHA-1: each five hexadecimal digits are four letters.
_OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
     q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST(('0x' || substr(h, CAST(1 + 5 * (k // 4) AS BIGINT), 5)) AS BIGINT) >> (5 * (3 - k % 4))::INTEGER) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM q
"""

#: Links by the shingles that two sets share; the smallest document that links reach, found from each in turn.
_OP7_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
  g AS (SELECT doc_id, unnest(list_distinct(CASE WHEN words IS NULL OR len(words) = 0 THEN CAST([] AS VARCHAR[])
            WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
            ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(list_slice(words, i, i + 3), ' ')) END)) AS s FROM w),
  n AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
  c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
  e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.size + nb.size - common)),
  u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.reached)
SELECT d.doc_id, CAST(coalesce(n.size, 0) AS BIGINT) AS n_shingles, k.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) k ON k.doc_id = d.doc_id
"""

#: All pairs of vectors, and what links reach.
_OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
  ok AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS n FROM v
         WHERE vec_id IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0
           AND list_inner_product(x, x) > 0),
  e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
        WHERE list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.95),
  r(vec_id, reached) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT v.vec_id, CAST((SELECT count(*) FROM e WHERE e.a = v.vec_id) AS BIGINT) AS n_links, k.component_id, v.vec_id = k.component_id AS kept
FROM v JOIN (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id) k ON k.vec_id = v.vec_id
"""

#: Shares by weight, dealt anew until no source is above twice its words.
_TARGETS_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS words, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
  u(unit, k) AS (SELECT 1.5e0 * sum(words) / sum(w), 0 FROM s
    UNION ALL SELECT * FROM (SELECT (1.5e0 * (SELECT sum(words) FROM s) - sum(CASE WHEN u.unit * s.w > 2 * s.words THEN 2 * s.words ELSE 0 END)) / nullif(sum(CASE WHEN u.unit * s.w > 2 * s.words THEN 0 ELSE s.w END), 0) AS unit, max(u.k) + 1 AS k
      FROM u, s) x WHERE unit IS NOT NULL AND k < 40),
  last AS (SELECT max(unit) AS unit FROM u)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, s.words AS source_size, round(least(2 * s.words, last.unit * s.w), 3) AS target
FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source, last
"""

_EDITED_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  n AS (SELECT doc_id, text, length(text) // 3 AS moved, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS other FROM d)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(substr(text, 1, length(text) - moved) || substr(other, 1, moved)) AS edited_sha256 FROM n
"""


def oracle_sql() -> dict[str, str]:
    return {"mix_targets": _TARGETS_SQL, "edited_texts": _EDITED_SQL, "op2_sharding": _OP2_SQL, "op6_embedding_dedup": _OP6_SQL, "op7_ngram_jaccard": _OP7_SQL, "op8_warc": _OP8_SQL}
