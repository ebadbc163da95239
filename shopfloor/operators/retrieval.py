"""TF-IDF retrieval of manual sections: a stored index and exact top-k search with pruning.

Weights follow the smooth-idf TF-IDF model: tf = raw term count, idf = ln((1+n)/(1+df)) + 1,
every vector L2-normalised, cosine = dot product of unit vectors. Terms are runs of at
least two letters/digits/underscores, lower-cased, minus an English stop list.

Index, built once per corpus and stored in the shared folder, each table when a query first reads it:

chunks    the sections themselves, so that manuals are split once
vectors   (ids, terms: array of (term, tf)): terms are counted within the row of a chunk, without an exchange; only
          rows whose ids repeat are brought together
idf       (term, df, idf)
norms     (ids, norm, profile): profile packs the share of the chunk's length that lies in each of ``BANDS``
          bands of document frequency, a byte each, rounded up
blocks    (term, top, postings: array of (ids, impact, profile)), impact = tf * idf / norm, at most 1. A block holds
          postings of one term, of a frequent one only those with impacts in one quarter-octave, ``BLOCK_ROWS`` or so
          of them (hash salted, so a term that a third of all chunks hold is many blocks); ``top`` is its
          largest impact
bounds    (term, top, low): largest and smallest block top of a term

Search, exact for any k. A query's unit weights w fall along its terms; what the terms after the i-th can add to
a chunk is at most the sum of their w * top; by Cauchy-Schwarz at most their length times the length the chunk has
left; and at most the sum over the bands of their length in the band times the chunk's.

1. seeds: all postings of the query's rarest terms, ``SEED_POSTINGS`` at most; the best few chunks by partial sum are
   scored in full; the k-th best of them is the threshold.
2. candidates: a chunk whose first term of the query is the i-th must hold a posting there that can reach the
   threshold with the rest. Blocks whose top cannot are never read; terms where no block can are left out
   entirely (these are the frequent, light ones with the long lists).
3. per (query, chunk) the partial sum of the postings read, plus the bounds of the terms not read, must
   reach the threshold; the pairs left are scored in full from ``vectors``.

Queries with fewer than k scored seeds have no threshold and are not pruned; chunks of similarity zero
fill them up, the latest first.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.functions.constants import ENGLISH_STOP_WORDS
from shopfloor.operators.rolling import split_hot_keys
from shopfloor.session import materialize

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: str | Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(t), F.lit(TOKEN_PATTERN), 0)


def term_counts(df: DataFrame, ids: list[str], text: str, stop_words: bool = True) -> DataFrame:
    """(ids..., term, tf)."""
    exploded = df.select(*ids, F.explode(tokens(text)).alias("term"))
    if stop_words:
        exploded = exploded.where(~F.col("term").isin(list(ENGLISH_STOP_WORDS)))
    return exploded.groupBy(*ids, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_vectors(df: DataFrame, ids: list[str], text: str, stop_words: bool = True) -> DataFrame:
    """(ids..., terms: array of (term, tf)) of the rows that have terms, in one pass: sorted terms, then the lengths of their
    runs. Rows whose ids repeat (NULL ids are ids, too) count as one and are grouped."""
    once, repeated = split_hot_keys(df.select(*ids, text), ids, 1)
    words = tokens(text)
    if stop_words:
        words = F.filter(words, lambda t: ~t.isin(list(ENGLISH_STOP_WORDS)))
    words = once.select(*ids, F.sort_array(words).alias("_words")).where(F.size("_words") > 0)
    w, first = F.col("_words"), F.col("_first")
    runs = words.select(*ids, "_words", F.filter(
        F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1))).alias("_first"))
    out = runs.select(*ids, F.transform(first, lambda p, j: F.struct(
        F.get(w, p).alias("term"), (F.coalesce(F.get(first, j + 1), F.size(w)) - p).cast("long").alias("tf"))).alias("terms"))
    if repeated is None:
        return out
    counts = term_counts(repeated.repartition(*ids), ids, text, stop_words)
    return out.unionByName(counts.groupBy(*ids).agg(F.collect_list(F.struct("term", "tf")).alias("terms")))


def idf_table(chunk_tf: DataFrame, ids: list[str], n_docs: int) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + n) / (1 + df)) + 1."""
    d = chunk_tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return d.select("term", "df", (F.log((F.lit(1.0) + n_docs) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def unit_weights(tf: DataFrame, idf: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., term, w) with w = tf * idf / ||tf * idf||; terms missing from idf drop."""
    w = tf.join(idf.select("term", "idf"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*ids)))
    return w.select(*ids, "term", (F.col("w") / norm).alias("w"))


BLOCK_ROWS = 1024
WHOLE_LISTS = 64
BANDS = 7
SEED_POSTINGS = 2048
SEED_BLOCKS = 8
SEEDS_PER_RESULT = 8
#: Ranking rounds similarities to 9 digits; bounds may be off by rounding errors far below this.
SLACK = 2e-9


def in_bands(lengths: list[Column], profile: Column) -> Column:
    """Sum over the bands of a length times the share that a chunk's profile has there."""
    shares = [F.shiftright(profile, 8 * b).bitwiseAND(F.lit(255).cast("long")) / 255 for b in range(BANDS)]
    return functools.reduce(lambda x, y: x + y, [n * s for n, s in zip(lengths, shares)])


class TfidfIndex:
    """The stored index over ``chunks(chunk ids..., content)``. Queries only read its tables."""

    def __init__(self, chunks: DataFrame, ids: list[str], text: str = "content", stop_words: bool = True,
                 n_docs: int | None = None):
        self.ids, self.stop_words = ids, stop_words
        self.chunks = materialize(chunks.repartition(*ids), "tfidf-chunks")
        self.n_docs = self.chunks.count() if n_docs is None else n_docs  # the fitted corpus size, a single number
        self.text = text

    @functools.cached_property
    def vectors(self) -> DataFrame:
        return materialize(term_vectors(self.chunks, self.ids, self.text, self.stop_words), "tfidf-vectors")

    @functools.cached_property
    def idf(self) -> DataFrame:
        return materialize(idf_table(self.tf, self.ids, self.n_docs), "tfidf-idf")

    @functools.cached_property
    def norms(self) -> DataFrame:
        ids, w = self.ids, F.col("tf") * F.col("idf")
        sums = self.tf.join(self.idf, "term").groupBy(*ids).agg(
            F.sum(w * w).alias("_all"), *[F.coalesce(F.sum(F.when(self.band == b, w * w)), F.lit(0.0)).alias(f"_{b}") for b in range(BANDS)])
        shares = [F.shiftleft(F.least(F.lit(255), F.ceil(255 * F.sqrt(F.col(f"_{b}") / F.col("_all")))).cast("long"), 8 * b)
                  for b in range(BANDS)]
        return materialize(sums.select(*ids, F.sqrt("_all").alias("norm"), functools.reduce(
            lambda x, y: x.bitwiseOR(y), shares).alias("profile")), "tfidf-norms")

    @functools.cached_property
    def blocks(self) -> DataFrame:
        ids, w = self.ids, F.col("tf") * F.col("idf")
        postings = self.vectors.join(self.norms, ids).select(*ids, "norm", "profile", F.inline("terms")).join(self.idf, "term") \
            .select("term", "df", "profile", *ids, (w / F.col("norm")).alias("impact"))
        level = F.when(F.col("df") > WHOLE_LISTS, F.floor(F.log2("impact") * 4).cast("int"))
        salt = F.pmod(F.xxhash64(*ids), F.ceil(F.col("df") / BLOCK_ROWS))
        return materialize(
            postings.groupBy("term", level.alias("level"), salt.alias("salt"))
            .agg(F.max("impact").alias("top"), F.collect_list(F.struct(*ids, "impact", "profile")).alias("postings"))
            .select("term", "top", "postings"), "tfidf-blocks")

    @functools.cached_property
    def bounds(self) -> DataFrame:
        return materialize(self.blocks.groupBy("term").agg(F.max("top").alias("top"), F.min("top").alias("low")),
                           "tfidf-bounds")

    @property
    def band(self) -> Column:
        """Band of a term by its document frequency, on a log scale up to the corpus size."""
        share = F.log(F.col("df").cast("double")) / math.log(self.n_docs + 1) if self.n_docs else F.lit(0.0)
        return F.least(F.lit(BANDS - 1), F.floor(share * BANDS)).cast("int")

    @property
    def tf(self) -> DataFrame:
        """(ids..., term, tf)."""
        return self.vectors.select(*self.ids, F.inline("terms"))

    def query_weights(self, queries: DataFrame, qid: str, text: str) -> DataFrame:
        qtf = term_counts(queries, [qid], text, self.stop_words)
        return unit_weights(qtf, self.idf, [qid])

    def similarities(self, queries: DataFrame, qid: str, text: str) -> DataFrame:
        """(qid, chunk ids..., similarity) for every pair sharing at least one term. The stored weights have a known
        size: where they can be broadcast, the chunks' vectors are dealt by their ids and no pair is moved."""
        qw = materialize(self.query_weights(queries, qid, text).join(self.idf.select("term", "idf"), "term")
                         .select(qid, "term", (F.col("w") * F.col("idf")).alias("qw")), "tfidf-weights")
        tf = self.vectors.repartition(*self.ids).select(*self.ids, F.inline("terms"))
        dots = tf.join(qw, "term").groupBy(qid, *self.ids).agg(F.sum(F.col("qw") * F.col("tf")).alias("dot"))
        return dots.join(self.norms, self.ids).select(qid, *self.ids, (F.col("dot") / F.col("norm")).alias("similarity"))

    def query_plan(self, queries: DataFrame, qid: str, text: str) -> DataFrame:
        """(qid, term, w, qw, df, band, top, low, rest, rest_top, rest_0 ..): the query's terms. Of the terms after this
        one (lighter): ``rest`` is the length of the weights, ``rest_b`` that in band b, ``rest_top`` the most
        they can add by their tops."""
        qw = self.query_weights(queries, qid, text).join(self.bounds, "term").join(self.idf, "term").withColumn("band", self.band)
        after = Window.partitionBy(qid).orderBy("w", F.col("term").desc()).rowsBetween(Window.unboundedPreceding, -1)
        square = F.col("w") * F.col("w")

        def upto(c: Column) -> Column:
            return F.coalesce(F.sum(c).over(after), F.lit(0.0))

        return materialize(qw.select(
            qid, "term", "w", (F.col("w") * F.col("idf")).alias("qw"), "df", "band", "top", "low",
            F.sqrt(upto(square)).alias("rest"), upto(F.col("w") * F.col("top")).alias("rest_top"),
            *[F.sqrt(upto(F.when(F.col("band") == b, square))).alias(f"rest_{b}") for b in range(BANDS)]), "tfidf-query")

    def score_pairs(self, pairs: DataFrame, plan: DataFrame, qid: str) -> DataFrame:
        """Full similarity of (qid, ids...) pairs, from the chunk vectors. Stored pairs have a known size, so few of them go
        to the vectors and norms and not these to them."""
        pairs = materialize(pairs.select(qid, *self.ids), "tfidf-pairs")
        terms = pairs.join(self.vectors, self.ids).select(qid, *self.ids, F.inline("terms"))
        dots = terms.join(plan.select(qid, "term", "qw"), [qid, "term"]).groupBy(qid, *self.ids) \
            .agg(F.sum(F.col("qw") * F.col("tf")).alias("dot"))
        return dots.join(pairs.join(self.norms, self.ids).select(qid, *self.ids, "norm"), [qid, *self.ids]) \
            .select(qid, *self.ids, (F.col("dot") / F.col("norm")).alias("similarity"))

    def seeds(self, plan: DataFrame, qid: str, k: int) -> DataFrame:
        """Fully scored pairs that are likely among the best. If the rarest term alone has too many postings, its
        best blocks are read."""
        rarest = Window.partitionBy(qid).orderBy("df", "term")
        best = Window.partitionBy(qid, "term").orderBy(F.col("_top").desc())
        few = F.col("_upto") <= SEED_POSTINGS
        some = plan.select(qid, "term", "w", F.sum("df").over(rarest).alias("_upto"), F.row_number().over(rarest).alias("_place")) \
            .where(few | (F.col("_place") == 1)).join(self.blocks.withColumnRenamed("top", "_top"), "term") \
            .withColumn("_n", F.row_number().over(best)).where(few | (F.col("_n") <= SEED_BLOCKS)) \
            .select(qid, "w", F.inline("postings")).groupBy(qid, *self.ids).agg(F.sum(F.col("w") * F.col("impact")).alias("part"))
        first = Window.partitionBy(qid).orderBy(F.col("part").desc(), *self.ids)
        few = some.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= SEEDS_PER_RESULT * k)
        return materialize(self.score_pairs(few, plan, qid), "tfidf-seeds")

    def candidates(self, plan: DataFrame, thresholds: DataFrame, qid: str) -> DataFrame:
        """(qid, ids...): every pair that can reach its query's threshold, and few others."""
        w, rest, least = F.col("w"), F.col("rest"), F.coalesce("threshold", F.lit(0.0)) - SLACK
        bands = [f"rest_{b}" for b in range(BANDS)]
        whole = F.sqrt(w * w + rest * rest)

        def reach(x: Column) -> Column:
            """The most a chunk can score whose first query term is this one, with impact up to x."""
            peak = F.when(x * whole < w, w * x + rest * F.sqrt(F.greatest(F.lit(0.0), 1 - x * x))).otherwise(whole)
            return F.least(w * x + F.col("rest_top"), peak)

        rated = plan.join(thresholds, qid, "left").withColumn("least", least) \
            .withColumn("all_read", reach(F.col("low")) >= F.col("least"))
        skipped = F.when(~F.col("all_read"), w * w).otherwise(0.0)
        unread = rated.groupBy(qid).agg(F.sum(skipped).alias("unread"), *[
            F.sqrt(F.sum(F.when(F.col("band") == b, skipped).otherwise(0.0))).alias(f"unread_{b}") for b in range(BANDS)])
        hits = rated.where(reach(F.col("top")) >= F.col("least")).drop("top", "low") \
            .join(self.blocks, "term").where(reach(F.col("top")) >= F.col("least")) \
            .select(qid, "w", "rest", "rest_top", *bands, "least", "all_read", F.inline("postings"))
        x, profile = F.col("impact"), F.col("profile")
        own = w * x + F.least(F.col("rest_top"), rest * F.sqrt(F.greatest(F.lit(0.0), 1 - x * x)),
                              in_bands([F.col(b) for b in bands], profile))
        pairs = hits.groupBy(qid, *self.ids).agg(
            F.sum(w * x).alias("part"), F.sum(x * x).alias("used"), F.max(own >= F.col("least")).alias("leads"),
            F.sum(F.when(F.col("all_read"), 0.0).otherwise(w * w)).alias("known"), F.max("least").alias("least"), F.max("profile").alias("profile"))
        more = F.least(F.sqrt(F.greatest(F.lit(0.0), F.col("unread") - F.col("known"))) * F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("used"))),
                       in_bands([F.col(f"unread_{b}") for b in range(BANDS)], profile))
        return pairs.where("leads").join(unread, qid).where(F.col("part") + more >= F.col("least")).select(qid, *self.ids)

    def search(self, queries: DataFrame, qid: str, text: str, k: int) -> tuple[DataFrame, DataFrame]:
        """(scored pairs that hold the best ``k`` of every query, thresholds (qid, threshold))."""
        plan = self.query_plan(queries, qid, text)
        seeds = self.seeds(plan, qid, k)
        w = Window.partitionBy(qid).orderBy(F.col("similarity").desc(), *self.ids)
        thresholds = materialize(seeds.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == k)
                                 .select(qid, F.col("similarity").alias("threshold")), "tfidf-thresholds")
        return materialize(self.score_pairs(self.candidates(plan, thresholds, qid), plan, qid), "tfidf-scored"), thresholds

    def top_k(self, queries: DataFrame, qid: str, text: str, k: int = 2) -> DataFrame:
        """Best ``k`` chunks per query (all chunks if there are fewer); ties on similarity go to
        the later chunk."""
        sims, thresholds = self.search(queries, qid, text, k)
        last = self.chunks.select(*self.ids).orderBy(*[F.col(c).desc() for c in self.ids]).limit(2 * k).collect()
        if last:  # at most 2 k rows: enough, since fewer than k of them can be matches of a short query
            kinds = {f.name: f.dataType for f in self.chunks.schema.fields}
            fill = F.array(*[F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in self.ids]) for r in last])
            short = queries.select(qid).distinct().join(thresholds, qid, "left_anti")
            pad = short.select(qid, F.inline(fill)).join(sims, [qid, *self.ids], "left_anti")
            sims = sims.unionByName(pad.withColumn("similarity", F.lit(0.0)))
        w = Window.partitionBy(qid).orderBy(F.round("similarity", 9).desc(), *[F.col(c).desc() for c in self.ids])
        return sims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


_STORED: dict = {}


def stored_index(chunks: DataFrame, ids: list[str], text: str = "content", stop_words: bool = True,
                 corpus: DataFrame | None = None) -> TfidfIndex:
    """The index of this corpus, built on first use in an application and kept by the content (row count and sum of
    row hashes, one pass) of ``corpus``: what the chunks are made from, or the chunks themselves."""
    corpus = chunks if corpus is None else corpus
    seen = corpus.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*corpus.columns).cast("decimal(38,0)"))).first()
    key = (corpus.sparkSession.sparkContext.applicationId, *chunks.columns, *ids, text, stop_words, *seen)
    if key not in _STORED:
        _STORED[key] = TfidfIndex(chunks, ids, text, stop_words)
    return _STORED[key]
