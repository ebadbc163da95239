"""Registered queries: manual sections, TF-IDF weights, cosine similarity, top-k evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopfloor.functions import constants as K
from shopfloor.operators import retrieval as RT
from shopfloor.operators.rolling import join_null_safe
from shopfloor.plans import sqltext as S
from shopfloor.plans.registry import register, round_doubles
from shopfloor.session import materialize
from shopfloor.sources import bindings as B

IDS = ["doc_id", "section_no"]
PARAMS = K.RetrievalParams()


def index(spark, sf_dir) -> RT.TfidfIndex:
    return RT.stored_index(B.chunks(spark, sf_dir), IDS, corpus=B.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def _stop_values() -> str:
    return ", ".join("('" + w.replace("'", "''") + "')" for w in K.ENGLISH_STOP_WORDS)


_TOK = "regexp_extract_all(lower({x}), '[\\pL\\pN_]{{2,}}')"

BENCH_QUERIES = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


def tfidf_sql(queries_cte: str = BENCH_QUERIES) -> str:
    return _TFIDF_TEMPLATE.replace("{QUERIES}", queries_cte)


_TFIDF_TEMPLATE = S.with_ctes(S.CHUNKS, f"""stop(term) AS (VALUES {_stop_values()}),
ctok AS (SELECT doc_id, section_no, unnest({_TOK.format(x='content')}) AS term FROM chunks),
ctf AS (SELECT doc_id, section_no, term, count(*) AS tf FROM ctok
        WHERE term NOT IN (SELECT term FROM stop) GROUP BY doc_id, section_no, term),
ncount AS (SELECT count(*) AS n FROM chunks),
idf AS (SELECT term, count(*) AS df,
               ln(CAST(1 + max(n) AS DOUBLE) / CAST(count(*) + 1 AS DOUBLE)) + 1.0 AS idf
        FROM ctf, ncount GROUP BY term),
cw AS (SELECT doc_id, section_no, term, tf * idf AS w FROM ctf JOIN idf USING (term)),
cn AS (SELECT doc_id, section_no, sqrt(sum(w * w)) AS norm FROM cw GROUP BY doc_id, section_no),
cu AS (SELECT doc_id, section_no, term, w / norm AS w FROM cw JOIN cn USING (doc_id, section_no)),
{{QUERIES}},
qtok AS (SELECT query_id, unnest({_TOK.format(x='query')}) AS term FROM queries),
qtf AS (SELECT query_id, term, count(*) AS tf FROM qtok WHERE term NOT IN (SELECT term FROM stop)
        GROUP BY query_id, term),
qw AS (SELECT query_id, term, tf * idf AS w FROM qtf JOIN idf USING (term)),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY query_id),
qu AS (SELECT query_id, term, w / norm AS w FROM qw JOIN qn USING (query_id)),
sims AS (SELECT query_id, doc_id, section_no, sum(qu.w * cu.w) AS similarity
         FROM qu JOIN cu USING (term) GROUP BY query_id, doc_id, section_no),
lastc AS (SELECT doc_id, section_no FROM chunks ORDER BY doc_id DESC, section_no DESC LIMIT 4),
padded AS (SELECT query_id, doc_id, section_no, similarity FROM sims
           UNION ALL SELECT DISTINCT q.query_id, l.doc_id, l.section_no, 0.0 FROM queries q, lastc l
           WHERE NOT EXISTS (SELECT 1 FROM sims s WHERE s.query_id = q.query_id AND s.doc_id = l.doc_id
                             AND s.section_no = l.section_no)),
topk AS (SELECT * , row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC,
                                       doc_id DESC, section_no DESC) AS rank
         FROM padded QUALIFY rank <= 2)""")
TFIDF = tfidf_sql()


@register("w_section_no", S.with_ctes(S.CHUNKS, """x AS (SELECT 1)
SELECT doc_id, section_no, source, CAST(length(content) AS INTEGER) AS n_chars FROM chunks"""))
def q_sections(spark, sf_dir):
    c = B.chunks(spark, sf_dir)
    return c.select("doc_id", "section_no", "source", F.length("content").alias("n_chars"))


@register("s_split_trim_len", S.with_ctes(S.CHUNKS, """x AS (SELECT 1)
SELECT doc_id, count(*) AS n_sections, CAST(sum(length(content)) AS BIGINT) AS n_chars,
  CAST(min(length(content)) AS INTEGER) AS shortest FROM chunks GROUP BY doc_id"""))
def q_split(spark, sf_dir):
    c = B.chunks(spark, sf_dir)
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sections"),
                                   F.sum(F.length("content")).cast("long").alias("n_chars"),
                                   F.min(F.length("content")).alias("shortest"))


@register("s_tokenize", TFIDF + """
SELECT doc_id, section_no, count(*) AS n_tokens FROM ctok GROUP BY doc_id, section_no""")
def q_tokenize(spark, sf_dir):
    c = B.chunks(spark, sf_dir)
    return c.select("doc_id", "section_no", F.explode(RT.tokens("content")).alias("t")) \
        .groupBy("doc_id", "section_no").agg(F.count(F.lit(1)).alias("n_tokens"))


@register("a_term_freq", TFIDF + """
SELECT term, CAST(sum(tf) AS BIGINT) AS total_tf, count(*) AS n_chunks FROM ctf GROUP BY term""")
def q_term_freq(spark, sf_dir):
    tf = RT.term_counts(B.chunks(spark, sf_dir), IDS, "content")
    return tf.groupBy("term").agg(F.sum("tf").cast("long").alias("total_tf"), F.count(F.lit(1)).alias("n_chunks"))


@register("j_stopwords", TFIDF + """
SELECT term, count(*) AS n_removed FROM ctok WHERE term IN (SELECT term FROM stop) GROUP BY term""")
def q_stopwords(spark, sf_dir):
    c = B.chunks(spark, sf_dir).select(F.explode(RT.tokens("content")).alias("term"))
    stop = spark.createDataFrame([(w,) for w in K.ENGLISH_STOP_WORDS], "term string")
    return c.join(F.broadcast(stop), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_removed"))


@register("a_idf", TFIDF + " SELECT term, df, round(idf, 6) AS idf FROM idf")
def q_idf(spark, sf_dir):
    return round_doubles(index(spark, sf_dir).idf)


@register("j_idf", TFIDF + " SELECT query_id, term, tf, round(tf * idf, 6) AS weight FROM qtf JOIN idf USING (term)")
def q_j_idf(spark, sf_dir):
    ix = index(spark, sf_dir)
    q = RT.term_counts(B.queries(spark, sf_dir), ["query_id"], "query")
    return round_doubles(q.join(ix.idf, "term").select("query_id", "term", "tf",
                                                       (F.col("tf") * F.col("idf")).alias("weight")))


@register("a_l2_norm", TFIDF + " SELECT doc_id, section_no, round(norm, 6) AS norm FROM cn")
def q_norm(spark, sf_dir):
    return round_doubles(index(spark, sf_dir).norms.select(*IDS, "norm"))


@register("j_query_terms", TFIDF + " SELECT query_id, term, round(w, 6) AS w FROM qu")
def q_query_terms(spark, sf_dir):
    ix = index(spark, sf_dir)
    return round_doubles(ix.query_weights(B.queries(spark, sf_dir), "query_id", "query"))


@register("a_cosine", TFIDF + """
SELECT q.query_id, coalesce(s.n_candidates, 0) AS n_candidates, round(coalesce(s.max_similarity, 0.0), 6) AS max_similarity
FROM (SELECT DISTINCT query_id FROM queries) q
LEFT JOIN (SELECT query_id, count(*) AS n_candidates, max(similarity) AS max_similarity FROM sims GROUP BY query_id) s
ON q.query_id IS NOT DISTINCT FROM s.query_id""")
def q_cosine(spark, sf_dir):
    """Every query: the sections that share a term with it and the best similarity; a query that shares none has similarity zero
    with every section."""
    return round_doubles(cosine_of(index(spark, sf_dir), B.queries(spark, sf_dir)))


def cosine_of(ix: RT.TfidfIndex, queries):
    best = ix.similarities(queries, "query_id", "query").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.max("similarity").alias("max_similarity"))
    return join_null_safe(queries.select("query_id").distinct(), best, ["query_id"], "left").select(
        "query_id", F.coalesce("n_candidates", F.lit(0).cast("long")).alias("n_candidates"),
        F.coalesce("max_similarity", F.lit(0.0)).alias("max_similarity"))


def evidence_of(ix: RT.TfidfIndex, queries, k: int = PARAMS.top_k):
    """Top-k sections per query (query_id, query) with their source label and text; with an empty
    corpus every query gets the default section."""
    top = materialize(ix.top_k(queries, "query_id", "query", k), "top-sections")  # few rows: the sections' texts are not moved to join them
    found = top.join(ix.chunks.select(*IDS, "source", "content"), IDS).select(
        "query_id", "rank", *IDS, "source", "content", F.round("similarity", 4).alias("similarity"))
    if ix.n_docs:
        return found
    kinds = {f.name: f.dataType for f in found.schema.fields}
    return queries.select("query_id").distinct().select(
        "query_id", F.lit(1).alias("rank"), *[F.lit(None).cast(kinds[c]).alias(c) for c in IDS],
        F.lit(K.DEFAULT_EVIDENCE_SOURCE).alias("source"), F.lit(K.DEFAULT_EVIDENCE_CONTENT).alias("content"),
        F.lit(1.0).alias("similarity"))


def evidence(spark, sf_dir, k: int = PARAMS.top_k):
    return evidence_of(index(spark, sf_dir), B.queries(spark, sf_dir), k)


_EVID = TFIDF + """,
ev AS (SELECT t.query_id, t.rank, t.doc_id, t.section_no, c.source, c.content, round(t.similarity, 4) AS similarity
       FROM topk t JOIN chunks c USING (doc_id, section_no))"""


@register("t_evidence_topk", _EVID + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, section_no, source, similarity FROM ev""")
def q_topk(spark, sf_dir):
    return evidence(spark, sf_dir).select("query_id", "rank", *IDS, "source", "similarity")


@register("t_top_source", _EVID + f"""
SELECT q.query_id, coalesce(e.source, '{K.DEFAULT_TOP_SOURCE}') AS top_source
FROM queries q LEFT JOIN (SELECT * FROM ev WHERE rank = 1) e USING (query_id)""")
def q_top_source(spark, sf_dir):
    ev = evidence(spark, sf_dir).where(F.col("rank") == 1).select("query_id", "source")
    q = B.queries(spark, sf_dir).select("query_id")
    return q.join(ev, "query_id", "left").select(
        "query_id", F.coalesce("source", F.lit(K.DEFAULT_TOP_SOURCE)).alias("top_source"))


@register("s_array_agg", _EVID + """
SELECT query_id, string_agg(source, ' | ' ORDER BY rank) AS evidence_sources,
       string_agg(CAST(similarity AS VARCHAR), ' | ' ORDER BY rank) AS evidence_scores
FROM ev GROUP BY query_id""")
def q_array_agg(spark, sf_dir):
    """Evidence list per query: a sorted array of (rank, source, similarity) structs."""
    ev = evidence(spark, sf_dir)
    lst = ev.groupBy("query_id").agg(F.sort_array(F.collect_list(
        F.struct("rank", "source", F.col("similarity").cast("string").alias("sim")))).alias("ev"))
    return lst.select("query_id", F.array_join(F.transform("ev", lambda e: e["source"]), " | ").alias("evidence_sources"),
                      F.array_join(F.transform("ev", lambda e: e["sim"]), " | ").alias("evidence_scores"))
