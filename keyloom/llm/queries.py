"""The opN queries over whole tables, with production parameters, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, golay_simhash, html_wrapper, language_id, packing, sharding, token_counts, topk_search, toxicity, url_filter
from .common import table


def tokenizer_path(name: str) -> str:
    """A public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.main_texts(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(table(spark, sf_dir, "documents"), 24)


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_html_extract, op3_decontaminate, op4_topk, op5_toxicity, op6_packing, op7_simhash, op8_token_counts, op9_url_filter, op10_sharding)
}

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def crc32_sql(text: str) -> str:
    """CTEs that end in c (doc_id, nth, crc): the CRC-32 of every text of documents, in chunks of 256 bytes. A chunk's
    register starts at 0 (the first, short one's at all ones) and moves 256 bytes on by a table for each of its bytes."""

    def step(v: int, bits: int) -> int:
        for _ in range(bits):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        return v

    one = [step(i, 8) for i in range(256)]
    on = [[step(i << 8 * k, 8 * 256) for i in range(256)] for k in range(4)]
    moved = "a"
    for k in range(4):
        part = f"({on[k]}::BIGINT[])[((a >> {8 * k}) & 255) + 1]"
        moved = part if k == 0 else f"xor({moved}, {part})"
    return f"""d AS (SELECT doc_id, {text} AS text, row_number() OVER () AS nth, hex(encode({text})) AS h FROM documents),
x AS (SELECT nth, k, CASE WHEN k = 0 THEN substr(h, 1, len(h) % 512) ELSE substr(h, 1 + len(h) % 512 + 512 * (k - 1), 512) END AS h
  FROM (SELECT *, unnest(range(0, 1 + len(h) // 512)) AS k FROM d) t),
y AS (SELECT nth, k, list_reduce(list_prepend(CASE WHEN k = 0 THEN 4294967295 ELSE 0 END::BIGINT,
    list_transform(range(1, 1 + len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
    lambda a, b: xor(a >> 8, ({one}::BIGINT[])[(xor(a, b) & 255) + 1])) AS r FROM x),
c AS (SELECT nth, xor(list_reduce(list(r ORDER BY k), lambda a, b: xor({moved}, b)), 4294967295) AS crc FROM y GROUP BY nth)"""


ORACLE_SQL = {
    "op3_decontaminate": f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
b AS (SELECT item_id, ws, least(8, len(ws)) AS m FROM (SELECT item_id, {WORDS} AS ws FROM benchmark) x WHERE len(ws) > 0 AND item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS i FROM b) x),
dw AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM b) y) x),
h AS (SELECT dw.doc_id, dw.i, dw.m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) x GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS sh
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(sh, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
""",
    "op4_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op10_sharding": f"""
WITH {crc32_sql("coalesce(text, '')")},
s AS (SELECT doc_id, CAST(strlen(text) + 8 AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, md5(text) AS mark, d.nth FROM d JOIN c ON d.nth = c.nth),
e AS (SELECT *, CAST(sum(size) OVER (ORDER BY mark, doc_id NULLS FIRST, nth ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, CAST(sum(size) OVER () AS BIGINT) AS total FROM s),
t AS (SELECT *, CAST(least(23, (2 * upto - size) * 24 // (2 * total)) AS INTEGER) AS shard FROM e)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY mark, doc_id NULLS FIRST, nth) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM t
""",
}
