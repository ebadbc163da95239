"""Pruned search against full scoring, the stored index, hot terms."""

import random

from pyspark.sql import functions as F

from shopfloor.operators import retrieval as RT
from shopfloor.plans import q_retrieval
from shopfloor.sources import bindings as B

from conftest import SF_MID, SF_SMALL

IDS = ["doc_id", "section_no"]


def full_top_k(ix, queries, k):
    """Every pair that shares a term scored, then ranked."""
    sims = {}
    for r in ix.similarities(queries, "query_id", "query").collect():
        sims.setdefault(r.query_id, {})[r.doc_id, r.section_no] = r.similarity
    ids = [tuple(r) for r in ix.chunks.select(*IDS).collect()]
    out = set()
    for (q,) in queries.select("query_id").distinct().collect():
        all_ = sorted(((round(sims.get(q, {}).get(c, 0.0), 9), c) for c in ids), reverse=True)[:k]
        out |= {(q, rank, *c, s) for rank, (s, c) in enumerate(all_, 1)}
    return out


def pruned_top_k(ix, queries, k):
    return {(r.query_id, r["rank"], r.doc_id, r.section_no, round(r.similarity, 9))
            for r in ix.top_k(queries, "query_id", "query", k).collect()}


def corpus(spark, seed=1):
    """Zipf words, one word in a third of all sections, copies and ties, empty and long sections."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(d, s, " ".join(r.choices(words, weights, k=r.randrange(1, 40)) + (["hotword"] if (d + s) % 3 == 0 else [])))
            for d in range(60) for s in range(1, 6)]
    rows += [(100, 1, rows[7][2]), (101, 1, rows[7][2]), (102, 1, ""), (103, 1, "!!"), (104, 1, " ".join(r.choices(words, weights, k=5000)))]
    queries = [(q, " ".join(r.choices(words, weights, k=r.randrange(1, 15)))) for q in range(40)]
    queries += [(90, rows[7][2]), (91, "hotword"), (92, "unknown words only"), (93, ""), (94, "w299"), (95, "w0 w1 w2 hotword")]
    return (spark.createDataFrame(rows, "doc_id long, section_no int, content string"),
            spark.createDataFrame(queries, "query_id long, query string"))


def test_pruned_equals_full(spark, monkeypatch):
    chunks, queries = corpus(spark)
    for block_rows, seed_blocks in ((1024, 8), (4, 1)):
        monkeypatch.setattr(RT, "BLOCK_ROWS", block_rows)
        monkeypatch.setattr(RT, "SEED_BLOCKS", seed_blocks)
        ix = RT.TfidfIndex(chunks, IDS)
        for k in (1, 2, 7):
            assert pruned_top_k(ix, queries, k) == full_top_k(ix, queries, k)


def test_pruning_on_the_tables(spark):
    """Same best sections, far fewer pairs scored than share a term."""
    ix = q_retrieval.index(spark, SF_MID)
    queries = B.queries(spark, SF_MID)
    scored, thresholds = ix.search(queries, "query_id", "query", 2)
    sharing = ix.similarities(queries, "query_id", "query")
    assert scored.count() < 0.2 * sharing.count()  # 1.2 percent on the ten times larger table
    best = sharing.join(thresholds, "query_id").where(F.col("similarity") >= F.col("threshold"))
    assert best.join(scored, ["query_id", *IDS], "left_anti").count() == 0


def test_blocks_hold_every_posting(spark):
    chunks, _ = corpus(spark, 2)
    ix = RT.TfidfIndex(chunks, IDS)
    posted = ix.blocks.select("term", "top", F.inline("postings"))
    assert posted.where("impact > top").count() == 0
    assert posted.count() == ix.tf.count()
    assert ix.blocks.agg(F.max(F.size("postings"))).first()[0] <= 4 * RT.BLOCK_ROWS


def test_index_is_kept_by_content(spark):
    a, b = q_retrieval.index(spark, SF_SMALL), q_retrieval.index(spark, SF_SMALL)
    assert a.vectors is b.vectors
    chunks = B.chunks(spark, SF_SMALL)
    c = RT.stored_index(chunks.where("doc_id % 2 = 0"), IDS)
    assert c.vectors is not a.vectors and c.n_docs < a.n_docs


def test_empty_corpus_and_queries(spark):
    chunks, queries = corpus(spark)
    ix = RT.TfidfIndex(chunks.where("false"), IDS)
    assert ix.top_k(queries, "query_id", "query").count() == 0
    assert RT.TfidfIndex(chunks, IDS).top_k(queries.where("false"), "query_id", "query").count() == 0


def test_term_vectors_equal_counted_terms(spark):
    """Repeated, null and missing ids, texts without terms and null texts; one pass where ids do not repeat."""
    rows = [(1, 1, "alpha beta Alpha gamma"), (1, 2, "the and of"), (2, 1, "beta beta"), (2, 1, "beta delta"), (None, 1, "alpha"),
            (None, 1, "alpha eps"), (3, None, "zeta"), (4, 1, ""), (5, 1, None), (6, 1, "zz aa zz mm aa zz")]
    df = spark.createDataFrame(rows, "a int, b int, content string")
    want = {(r.a, r.b, r.term): r.tf for r in RT.term_counts(df, ["a", "b"], "content").collect()}
    got = RT.term_vectors(df, ["a", "b"], "content").select("a", "b", F.inline("terms")).collect()
    assert {(r.a, r.b, r.term): r.tf for r in got} == want and len(got) == len(want)
    once = RT.term_vectors(df.where("a > 3"), ["a", "b"], "content")
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    assert once.schema["terms"].dataType == RT.term_vectors(df, ["a", "b"], "content").schema["terms"].dataType


def test_index_builds_what_is_read(spark):
    df = spark.createDataFrame([(k, 1, f"alpha term{k % 3} word{k}") for k in range(20)], "a int, b int, content string")
    ix = RT.TfidfIndex(df, ["a", "b"])
    assert ix.idf.count() == 24 and not {"norms", "blocks", "bounds"} & set(vars(ix))
    assert ix.bounds.count() == 24 and "blocks" in vars(ix)


def test_every_query_has_its_cosine(spark):
    """Also queries that share no term with any section (92, 93), with similarity zero."""
    chunks, queries = corpus(spark)
    ix = RT.TfidfIndex(chunks, IDS)
    got = {r.query_id: (r.n_candidates, r.max_similarity) for r in q_retrieval.cosine_of(ix, queries).collect()}
    sims = {}
    for r in ix.similarities(queries, "query_id", "query").collect():
        sims.setdefault(r.query_id, []).append(r.similarity)
    assert got == {q: (len(sims.get(q, [])), max(sims.get(q, [0.0]))) for (q,) in queries.select("query_id").collect()}
    assert got[92] == got[93] == (0, 0.0) and len(got) == 46
