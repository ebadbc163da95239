"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds
th_1 < ... < th_{K-1} cut its score s: P(grade <= k) = sigmoid(th_k - s). This gives every
document an expected grade and a tail probability P(grade >= k), which selection uses: a
document is kept when its probability of the best grade reaches a cut. The cut is found on
rated documents held back from a first fit, as the highest that keeps ``KEEP_SHARE`` of
those of the best grade; the final fit then uses all of them.

Features: lower-cased words without ASCII punctuation and their 4- and 5-byte beginnings,
hashed by CRC-32 (dampened counts, unit length); the byte distribution (square roots); length,
share of distinct words and a constant. Whole texts are read, word by word.

Fitting takes at most ``max_train`` rated documents, those with the smallest hash of their id
(TRAIN_DOCS, a documented bound on the sample, the same at every table size); of rows that repeat an id the
smallest text stands for all, reduced to it before any row moves. Their features
are made in parallel; one task with this bounded sample runs adaptive stochastic gradients
in a fixed order, so reruns agree. Scoring is one map-only pass with the weights broadcast
(1 MB).

Defined results: null text is the empty text. Ratings that are null or outside 0..K-1 are not
used. Without any usable rating nothing is known: probabilities are null and every
document is kept. Rows that repeat an id are scored one by one; an empty table gives an
empty result. Columns other than id and text are passed through by ``select_quality``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.session import small_batches

HASHED = 1 << 18
SIZE = HASHED + 256 + 3
TRAIN_DOCS = 16_384
EPOCHS = 8
RATE = 0.7
KEEP_SHARE = 0.99
DENSE_SCALE = 3.0
HOLD_BACK = 5
MAX_CUT = 0.96
PUNCTUATION = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
SLICE = 1 << 20


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) of the non-zero features. Counting goes in slices of words."""
    counts = np.zeros(0, np.int64)
    words = text.lower().translate(None, PUNCTUATION).split()
    seen = []
    for a in range(0, len(words), SLICE):
        part = words[a:a + SLICE]
        tokens = part + [b"4" + w[:4] for w in part if len(w) > 4] + [b"5" + w[:5] for w in part if len(w) > 5]
        seen.append(np.unique(np.fromiter(map(zlib.crc32, tokens), np.uint32, len(tokens)) % HASHED,
                              return_counts=True))
    if len(seen) > 1:
        index, back = np.unique(np.concatenate([s[0] for s in seen]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([s[1] for s in seen]))
    elif seen:
        index, counts = seen[0]
    else:
        index = np.zeros(0, np.uint32)
    value = np.log1p(counts)
    value = value / max(1e-9, float(np.sqrt(value @ value)))
    spread = np.sqrt(np.bincount(np.frombuffer(text, np.uint8), minlength=256) / max(1, len(text)))
    extra = [np.log1p(len(words)) / 10, len(set(words)) / max(1, len(words)), 1.0]
    index = np.concatenate((index.astype(np.int32), np.arange(HASHED, SIZE, dtype=np.int32)))
    value = np.concatenate((value, DENSE_SCALE * spread, DENSE_SCALE * np.array(extra))).astype(np.float32)
    return index[value != 0], value[value != 0]


@dataclass
class CumulativeLink:
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def at_most(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for k = 0 .. K-2, one row per score."""
        z = np.clip(self.thresholds[None, :] - np.asarray(score)[:, None], -30, 30)
        return 1 / (1 + np.exp(-z))

    def score(self, text: bytes) -> float:
        index, value = features(text)
        return float(self.weights[index] @ value)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int, epochs: int = EPOCHS,
        rate: float = RATE, seed: int = 0) -> CumulativeLink:
    """Maximum likelihood by adaptive stochastic gradients (AdaGrad)."""
    w, gw = np.zeros(SIZE, np.float32), np.full(SIZE, 1e-3, np.float32)
    share = np.bincount([g for *_, g in rows], minlength=grades) + 1.0
    upto = (np.cumsum(share) / share.sum())[:-1]
    th = np.log(upto / (1 - upto))
    gt = np.full(grades - 1, 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            index, value, g = rows[i]
            p = 1 / (1 + np.exp(-np.clip(th - float(w[index] @ value), -30, 30)))
            high, low = (p[g] if g < grades - 1 else 1.0), (p[g - 1] if g else 0.0)
            likely = max(high - low, 1e-9)
            up, down = high * (1 - high) / likely, low * (1 - low) / likely
            step = ((up - down) * value).astype(np.float32)  # the gradient along the score
            gw[index] += step * step
            w[index] -= rate * step / np.sqrt(gw[index])
            move = np.zeros(grades - 1)
            if g < grades - 1:
                move[g] -= up
            if g:
                move[g - 1] += down
            gt += move * move
            th = np.maximum.accumulate(th - rate * move / np.sqrt(gt))
    return CumulativeLink(w, th)


def fit_with_cut(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int, epochs: int = EPOCHS,
                 keep: float = KEEP_SHARE) -> CumulativeLink:
    """Fit on all rows; the cut comes from every ``HOLD_BACK``-th, unseen by a first fit."""
    back = [r for r in rows[::HOLD_BACK] if r[2] == grades - 1]
    rest = [r for k, r in enumerate(rows) if k % HOLD_BACK]
    model = fit(rows, grades, epochs)
    if back and rest:
        first = fit(rest, grades, epochs)
        tail = 1 - first.at_most(np.array([float(first.weights[i] @ v) for i, v, _ in back]))[:, -1]
        model.cut = float(np.clip(np.quantile(tail, 1 - keep, method="lower"), 0.05, MAX_CUT))
    return model


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, b.num_rows, 256):
            part = b.slice(a, 256)
            made = [features(t.as_py() or b"") for t in part.column(2)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([m[0] for m in made], pa.list_(pa.int32())),
                 pa.array([m[1] for m in made], pa.list_(pa.float32()))], names=["order", "grade", "index", "value"])


def _place(row: tuple) -> tuple[int, int, int]:
    return row[0], row[1], len(row[2])


def _by_values(same: list[tuple]) -> list[tuple]:
    """Rows of one place, ordered by their values; few places have more than one, so few values are copied."""
    return sorted(same, key=lambda r: r[3].tobytes()) if len(same) > 1 else same


def _fit_task(grades: int, epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for o, g, i, v in zip(*(b.column(c) for c in range(4))):
                rows.append((o.as_py(), g.as_py(), i.values.to_numpy(), v.values.to_numpy()))
        if rows:
            rows.sort(key=_place)
            rows = [r for _, same in groupby(rows, _place) for r in _by_values(list(same))]
            m = fit_with_cut([(i, v, g) for _, g, i, v in rows], grades, epochs)
            yield pa.RecordBatch.from_arrays([pa.array([m.weights.astype("<f4").tobytes()]), pa.array(
                [m.thresholds.astype("<f8").tobytes()]), pa.array([m.cut])], names=["w", "th", "cut"])
    return run


def training_rows(docs: DataFrame, ratings: DataFrame, id_col: str, text_col: str, grade_col: str, grades: int,
                  max_train: int) -> DataFrame:
    """(order, grade, text) of at most ``max_train`` rated documents, those with the smallest id hash."""
    rated = ratings.select(F.col(id_col).alias("_id"), F.col(grade_col).cast("int").alias("_grade")) \
        .where(F.col("_id").isNotNull() & F.col("_grade").between(0, grades - 1)) \
        .distinct().withColumn("_order", F.xxhash64("_id"))
    n = rated.count()
    if n > 3 * max_train:  # the smallest hashes lie far below this; fewer rows meet in the last sort
        few = rated.where(F.col("_order") < int(-2**63 + 2**64 * 3 * max_train / n))
        rated = few if few.count() >= max_train else rated
    sample = rated.orderBy("_order", "_id", "_grade").limit(max_train)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("binary").alias("_text"))
    joined = texts.join(F.broadcast(sample), F.col("_doc") == F.col("_id"))  # at most max_train rows
    single = joined.groupBy("_order", "_id", "_grade").agg(F.min("_text").alias("text"))  # rows may repeat an id
    return single.select(F.col("_order").alias("order"), F.col("_grade").alias("grade"), "text")


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          grade_col: str = "grade", grades: int = 3, max_train: int = TRAIN_DOCS,
          epochs: int = EPOCHS) -> CumulativeLink | None:
    """Fit on the ``max_train`` rated documents with the smallest id hash."""
    made = training_rows(docs, ratings, id_col, text_col, grade_col, grades, max_train).mapInArrow(
        _featurize, "order bigint, grade int, index array<int>, value array<float>")
    with small_batches(docs.sparkSession):
        row = made.repartition(1).mapInArrow(_fit_task(grades, epochs), "w binary, th binary, cut double").first()
    return row and CumulativeLink(np.frombuffer(row["w"], "<f4"), np.frombuffer(row["th"], "<f8"), row["cut"])


def scorer(spark, model: CumulativeLink):
    """A column function: text -> struct(expected_grade, tail), tail = P(best grade)."""
    shared = spark.sparkContext.broadcast((model.weights, model.thresholds))

    @F.pandas_udf("expected_grade double, tail double")
    def rate(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = CumulativeLink(*shared.value)
        for part in texts:
            s = np.fromiter((m.score(t or b"") for t in part), float, len(part))
            p = m.at_most(s)
            yield pd.DataFrame({"expected_grade": (1 - p).sum(axis=1), "tail": 1 - p[:, -1]})

    def of(text: Column) -> Column:
        return rate(F.coalesce(text, F.lit("")).cast("binary"))
    return of


def rate_documents(docs: DataFrame, model: CumulativeLink | None, id_col: str = "doc_id", text_col: str = "text",
                   min_tail: float | None = None) -> DataFrame:
    """One row per input row: ``id_col``, expected_grade, tail_probability, kept."""
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select(F.col(id_col), none.alias("expected_grade"), none.alias("tail_probability"),
                           F.lit(True).alias("kept"))
    rated = docs.select(F.col(id_col).alias("id"), scorer(docs.sparkSession, model)(F.col(text_col)).alias("r"))
    return rated.select(F.col("id").alias(id_col), F.round("r.expected_grade", 6).alias("expected_grade"),
                        F.round("r.tail", 6).alias("tail_probability"), (F.col("r.tail") >= (model.cut if min_tail is None else min_tail)).alias("kept"))


def select_quality(docs: DataFrame, model: CumulativeLink | None, text_col: str = "text",
                   min_tail: float | None = None) -> DataFrame:
    """The rows whose probability of the best grade is at least ``min_tail`` (default: the
    model's cut), all columns kept."""
    if model is None:
        return docs
    min_tail = model.cut if min_tail is None else min_tail
    return docs.where(scorer(docs.sparkSession, model)(F.col(text_col))["tail"] >= min_tail)


def label_grades(labels: DataFrame) -> DataFrame:
    """Grades of the labels table: 0 low quality, 1 good but toxic, 2 good and clean."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1)
                         .when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))
