"""Input tables by name, and settings shared by the ready-made queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.operators.corpus import FIRST_BYTE_ID, RESERVED, SPELLED_ID, VOCABULARY_SIZE

SEQ_LEN = 2048
MICRO_BATCH = 4
ACCUMULATE = 8
SHARD_SIZE = 20_000
SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Shared starts of the check queries: the same rules in SQL.
_NATIVE = r"'[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'"

#: The ids of a ``token`` whose ``token_id`` is null outside the vocabulary.
SPELL_SQL = f"""CASE WHEN token_id IS NOT NULL THEN [token_id] ELSE list_concat([{SPELLED_ID}::BIGINT], list_transform(
        range(octet_length(encode(token))), lambda b: ('0x' || substr(hex(token), 2 * b + 1, 2))::BIGINT + {FIRST_BYTE_ID})) END"""

TOKENS_SQL = f"""
tokens AS (SELECT doc_id, regexp_extract_all(text, {_NATIVE}) AS words FROM documents WHERE text IS NOT NULL AND text <> ''),
word_rows AS (SELECT doc_id, unnest(words) AS token, generate_subscripts(words, 1) AS w FROM tokens),
vocab AS (
    SELECT token, n, (row_number() OVER (ORDER BY n DESC, token) + {RESERVED - 1})::BIGINT AS token_id
    FROM (SELECT token, count(*) AS n FROM word_rows GROUP BY token ORDER BY n DESC, token LIMIT {VOCABULARY_SIZE - RESERVED})
),
spelled AS (SELECT doc_id, w, {SPELL_SQL} AS ids FROM word_rows LEFT JOIN vocab USING (token)),
sized AS (
    SELECT doc_id, (coalesce(sum(len(ids)), 0) + 1)::BIGINT AS n_tokens FROM tokens LEFT JOIN spelled USING (doc_id) GROUP BY doc_id
),
offsets AS (
    SELECT doc_id, n_tokens,
           (coalesce(sum(n_tokens) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
    FROM sized
),
total AS (SELECT coalesce(sum(n_tokens), 0)::BIGINT AS t FROM sized)"""

IDS_SQL = (
    TOKENS_SQL
    + """,
spelled_rows AS (SELECT doc_id, w, unnest(ids) AS id, generate_subscripts(ids, 1) AS b FROM spelled),
id_rows AS (
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY w, b) - 1 AS i, id FROM spelled_rows
    UNION ALL SELECT doc_id, n_tokens - 1, 0 FROM sized
),
stream AS (SELECT doc_id, i, start + i AS pos, id FROM id_rows JOIN offsets USING (doc_id))"""
)
