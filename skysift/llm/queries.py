"""Registered queries of this folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skysift.llm import decontaminate, minhash, nn_descent, pieces, pii, secrets, suffix_dedup, token_counts, toxicity, warc
from skysift.llm._common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(spark, table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(spark, table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spark, table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(spark, table(spark, sf_dir, "documents"), percent=80, shingle=2)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(spark, table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(spark, table(spark, sf_dir, "documents"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_vectors(spark, table(spark, sf_dir, "embeddings"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_near_copies": op3_near_copies,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_secrets": op6_secrets,
    "op7_pii": op7_pii,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_near_vectors": op9_near_vectors,
    "op10_warc": op10_warc,
    "pipeline": pipeline,
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _reach(links: str, nodes: str) -> str:
    """CTEs after links(a, b), both ways round: root(node, component), component the smallest node reachable."""
    return f"reach AS (SELECT a AS node, b AS other FROM {links} UNION SELECT reach.node, l.b FROM reach JOIN {links} l ON reach.other = l.a), root AS (SELECT n.id AS node, least(n.id, coalesce(min(other), n.id)) AS component FROM {nodes} n LEFT JOIN reach ON reach.node = n.id GROUP BY n.id)"


#: SQL for DuckDB. Words and windows are taken from whole texts of whole tables. op1, op4 and op8 need byte strings of
#: every position or a tokenizer's library, op5, op6 and the added spans of op7 a model: brute-force and library tests.
SQL: dict[str, str] = {
    "op2_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
j AS (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS pos FROM i),
k AS (SELECT DISTINCT item_id, n, array_to_string(w[pos : pos + n - 1], ' ') AS x FROM j),
e AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d CROSS JOIN (SELECT DISTINCT n FROM k)),
f AS (SELECT doc_id, n, pos, array_to_string(w[pos : pos + n - 1], ' ') AS x FROM e),
h AS (SELECT doc_id, pos, n, item_id FROM f JOIN k USING (n, x)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)""",
    "op3_near_copies": rf"""
WITH RECURSIVE d AS (SELECT doc_id AS id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT id, x FROM (SELECT id, CASE WHEN len(w) = 1 THEN w[1] ELSE unnest(list_transform(range(1, greatest(len(w), 2)), lambda i: w[i] || ' ' || w[i + 1])) END AS x FROM d WHERE len(w) > 0)),
z AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT p.id AS a, q.id AS b, count(*) AS n FROM s p JOIN s q ON p.x = q.x AND p.id <> q.id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
{_reach('l', 'd')}
SELECT d.id AS doc_id, coalesce(z.n, 0) AS n_shingles, component AS component_id, component = d.id AS kept FROM d LEFT JOIN z ON z.id = d.id JOIN root ON root.node = d.id""",
    "op9_near_vectors": f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT p.id AS a, q.id AS b FROM u p JOIN u q ON p.id <> q.id AND len(p.e) = len(q.e) WHERE list_dot_product(p.e, q.e) >= 0.95),
n AS (SELECT a AS id, count(*) AS n_links FROM l GROUP BY a),
{_reach('l', 'v')}
SELECT v.id AS vec_id, coalesce(n_links, 0) AS n_links, component AS component_id, component = v.id AS kept FROM v LEFT JOIN n USING (id) JOIN root ON root.node = v.id""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT h, max(page_id) AS last FROM p GROUP BY h),
x AS (SELECT page_id, last, strlen(p.h) AS payload_bytes, sha1(p.h) AS hex FROM p JOIN m USING (h)),
g AS (SELECT *, list_transform(range(8), lambda k: list_reduce(list_transform(range(1, 6), lambda i: CAST(instr('0123456789abcdef', substr(hex, CAST(5 * k + i AS INTEGER), 1)) - 1 AS BIGINT)), lambda a, b: a * 16 + b)) AS five FROM x)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (five[1 + i // 4] >> (15 - 5 * (i % 4))) % 32 AS INTEGER), 1)), '') AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM g""",
}
