"""Queries ``opN_<name>`` over whole tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, common, decontam, langid, minhash, sharding, tokenfile, toxicity, urlfilter, warc

SHARDS = 16
RULES = ["block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/"]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    p = docs.select("doc_id", toxicity.predict(docs, model).alias("p"))
    return p.select("doc_id", *[F.col(f"p.{n}").alias(f"p_{n}") for n in model.names], (F.col("p.toxic") >= 0.5).alias("toxic"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(common.table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(common.table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.table(spark, sf_dir, "documents"), k=4)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scan(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    p = docs.select("doc_id", langid.held_out().alias("held_out"), langid.predict(docs, model).alias("p"))
    return p.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = warc.archive(common.table(spark, sf_dir, "pages"), common.scratch(spark, "warc"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.scratch(spark, "tokens")
    tokenfile.write_tokens(common.table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return tokenfile.digest(tokenfile.read_tokens(spark, out))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [urlfilter.Rule.parse(*r.split()) for r in RULES]
    return urlfilter.judge(common.table(spark, sf_dir, "pages"), rules)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_ann, op3_sharding, op4_bpe, op5_near_dedup, op6_decontamination, op7_language_id, op8_warc, op9_token_files, op10_url_filters, pipeline)}

_CRC_TABLE = []
for _i in range(256):
    for _ in range(8):
        _i = _i >> 1 ^ (0xEDB88320 if _i & 1 else 0)
    _CRC_TABLE.append(_i)

ORACLE_SQL = {
    "op2_ann": """
        WITH e AS (
          SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
              FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op5_near_dedup": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
          FROM documents),
        g AS (
          SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
            ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS s
          FROM w),
        x AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM g),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        r(v, c) AS (SELECT doc_id, doc_id FROM g UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.v AND r.c < p.b),
        m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m.c AS component_id, m.c = doc_id AS kept
        FROM g JOIN m ON m.v = g.doc_id""",
    "op6_decontamination": r"""
        WITH d AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
          FROM documents),
        b AS (
          SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
          FROM benchmark),
        bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i+n-1], ' ') AS t FROM (
          SELECT item_id, ws, least(8, len(ws)) AS n, unnest(range(1, len(ws) - least(8, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
        sizes AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i+n-1], ' ') AS t FROM (
          SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
        h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, t)),
        hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
          sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
          CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to FROM f""",
    "op10_url_filters": r"""
        WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r(action, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        m AS (SELECT page_id, arg_max(rh || rp, len(rh || rp)) AS rule, arg_max(action, len(rh || rp)) AS verdict
              FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
        SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)""",
    "op3_sharding": f"""
        WITH t AS (SELECT {_CRC_TABLE}::UBIGINT[] AS tbl),
        c AS (
          SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
            xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS UBIGINT))),
              lambda c, b: xor(c >> 8, tbl[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295::UBIGINT) AS crc
          FROM documents, t),
        s AS (SELECT doc_id, k, substr(md5(doc_id || ':' || k), 1, 13) AS u FROM documents, range(17) r(k)),
        a AS (SELECT doc_id, arg_max(k, u) FILTER (k < 16) AS shard, arg_max(k, u) AS grown FROM s GROUP BY doc_id)
        SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INT) AS shard, CAST(grown AS INT) AS grown_shard,
          row_number() OVER (PARTITION BY shard ORDER BY substr(md5(doc_id || ':' || CAST(crc AS BIGINT)), 1, 2), doc_id) - 1 AS slot
        FROM c JOIN a USING (doc_id)""",
}
