"""Registered corpus queries: thin wrappers that derive the contract's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopfloor.llm import (decontaminate, exact_dedup, filter_audit, importance, langid, licenses, mixing, pii, quality,
                           sharding, simhash, token_codes, warc)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_pii")
def op1(spark, sf_dir):
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    spans = F.sort_array(F.concat("base", "extra"))
    return found.select(
        "doc_id", *[pii.count_kind(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(spans).alias("spans"))


@query("op3_simhash")
def op3(spark, sf_dir):
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query("op5_decontaminate", f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_SQL} AS ws FROM benchmark),
bw AS (SELECT item, len(ws) AS n, ws, unnest(range(greatest(len(ws) - 12, 1))) AS i FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, least(n, 13) AS l, array_to_string(ws[i + 1: i + 13], ' ') AS gram FROM bw),
d AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM d),
ls AS (SELECT DISTINCT l FROM win),
g AS (SELECT doc_id, i, l, array_to_string(ws[i + 1: i + l], ' ') AS gram FROM p, ls WHERE i + l <= len(ws)),
h AS (SELECT doc_id, i, g.l, item FROM g JOIN win ON g.gram = win.gram AND g.l = win.l),
hw AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS w FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""")
def op5(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")) \
        .drop("row", "hit_spans", "h")


@query("op7_mixing")
def op7(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


@query("op9_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op9(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query("op2_token_codes")
def op2(spark, sf_dir):
    import public_tokenizers

    return token_codes.token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_licenses")
def op4(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query("op6_quality")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.label_grades(table(spark, sf_dir, "labels")))
    return quality.rate_documents(docs, model)


@query("op8_langid")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


@query("op10_warc", """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id <> max(page_id) OVER w
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id <> max(page_id) OVER w
            THEN max(page_id) OVER w END AS refers_to
FROM pages WINDOW w AS (PARTITION BY coalesce(html, ''))""")
def op10(spark, sf_dir):
    return warc.dedup_archive(table(spark, sf_dir, "pages"))


@query("op11_importance")
def op11(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_filter_audit", r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
m AS (SELECT doc_id, part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(range(5)) AS i),
o AS (SELECT a.i AS a, b.i AS b, c.i AS c, d.i AS d, e.i AS e FROM f a, f b, f c, f d, f e
      WHERE (1 << a.i) + (1 << b.i) + (1 << c.i) + (1 << d.i) + (1 << e.i) = 31),
s AS (SELECT substr('ABCDE', a + 1, 1) || substr('ABCDE', b + 1, 1) || substr('ABCDE', c + 1, 1) || substr('ABCDE', d + 1, 1)
        || substr('ABCDE', e + 1, 1) AS filter_order, unnest([a, b, c, d, e]) AS fil, unnest([1, 2, 3, 4, 5]) AS step,
        unnest([0, 1 << a, (1 << a) + (1 << b), (1 << a) + (1 << b) + (1 << c), 31 - (1 << e)]) AS before FROM o),
r AS (SELECT part, filter_order, step, fil,
        sum(CASE WHEN mask & (before | (1 << fil)) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & before = 0 AND mask & (1 << fil) > 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & before > 0 AND mask & (1 << fil) > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = 1 << fil THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & (1 << fil) > 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & before = 0 AND mask & (1 << fil) > 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, fil)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, fil) AS BIGINT) AS shapley
FROM r""")
def op12(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_sharding")
def op13(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
