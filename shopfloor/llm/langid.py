"""Language identification with error-correcting output codes.

Every learned language gets a codeword of +-1 bits: all distinct two-way splits for up to six
languages, else the best of many seeded random codes by minimum distance. One binary
logistic classifier per bit predicts it from hashed byte n-grams (1 to 3 bytes of the lower-cased
text). Decoding is loss-weighted: each bit's logistic loss against a codeword counts with the
bit's accuracy on held-back training documents, the language of least loss wins, and a small
margin to the second is flagged as ambiguous.

Learning takes at most ``per_language`` documents of each language, those with the
smallest hash of their id (a documented bound, alike at every table size), only from documents
whose crc32(id as text) mod 4 is not 2 and whose language is known. One task fits the
bounded sample in a fixed order; prediction is one map-only pass over whole texts.

Defined results: text that is null or has no letter is ``und`` with score 0. A null id is held out.
With no learnable document every text is ``und``; with one language it is always predicted.
Rows that repeat an id are predicted one by one; an empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.session import materialize

BITS = 15
SIZE = 1 << BITS
PER_LANGUAGE = 1500
EPOCHS = 4
RATE = 0.5
AMBIGUOUS = 0.6
UNKNOWN = "und"
SLICE = 1 << 20


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(index, value): square roots of hashed n-gram counts, unit length. Long texts are counted
    in slices that overlap by two bytes."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    counts = np.zeros(SIZE, np.int64)
    mix = np.uint32(2654435761)
    for a in range(0, len(data), SLICE):
        b = data[a:a + SLICE + 2].astype(np.uint32)
        own = min(SLICE, len(data) - a)
        two = b[:-1] << np.uint32(8) | b[1:]
        three = two[:-1] << np.uint32(8) | b[2:]
        for n, gram in enumerate((b[:own], two[:own], three[:own]), 1):
            counts += np.bincount((gram * mix + np.uint32(n * 40503)) >> np.uint32(32 - BITS), minlength=SIZE)
    index = np.flatnonzero(counts)
    value = np.sqrt(counts[index]).astype(np.float32)
    return index.astype(np.int32), value / max(1e-9, float(np.sqrt(value @ value)))


def codewords(k: int, seed: int = 0) -> np.ndarray:
    """k codewords of +-1 bits, as far apart as the method finds."""
    if k <= 1:
        return np.ones((k, 0), np.int8)
    if k <= 6:
        splits = np.arange(1, 1 << (k - 1))  # language 0 is always on the + side
        return np.array([[1 if i == 0 else (-1 if s >> (i - 1) & 1 else 1) for s in splits] for i in range(k)], np.int8)
    rng, length, best, apart = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k))), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (k, length))
        split = np.abs(code.sum(axis=0)) < k  # a bit must separate something
        distance = (length - (code.astype(int) @ code.T.astype(int))) // 2 + np.eye(k, dtype=int) * length
        if split.all() and distance.min() > apart:
            best, apart = code, distance.min()
    return best


class Ecoc:
    def __init__(self, languages, code, weights, bias, bit_weights):
        self.languages, self.code, self.weights = list(languages), code, weights
        self.bias, self.bit_weights = bias, bit_weights

    def losses(self, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of every codeword."""
        margin = value @ self.weights[index] + self.bias
        return np.logaddexp(0, -self.code * margin[None, :]) @ self.bit_weights

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score 0..1, ambiguous)."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        loss = self.losses(*features(text))
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        best = int(loss.argmin())  # the first of equal losses
        return self.languages[best], float(p[best]), bool(p[best] < AMBIGUOUS)

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, languages=np.array(self.languages, dtype=str), code=self.code, weights=self.weights,
                 bias=self.bias, bit_weights=self.bit_weights)
        return out.getvalue()

    @staticmethod
    def loads(data: bytes) -> Ecoc:
        z = np.load(io.BytesIO(data))
        return Ecoc(z["languages"].tolist(), z["code"], z["weights"], z["bias"], z["bit_weights"])


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 0) -> Ecoc:
    """All bits at once by AdaGrad; every tenth document is held back to weigh the bits, then
    learned from as well."""
    languages = sorted({lang for *_, lang in rows})
    code = codewords(len(languages), seed)
    n_bits, place = code.shape[1], {lang: i for i, lang in enumerate(languages)}
    w, gw = np.zeros((SIZE, n_bits), np.float32), np.full((SIZE, n_bits), 1e-3, np.float32)
    bias, gb = np.zeros(n_bits, np.float32), np.full(n_bits, 1e-3, np.float32)
    rng = np.random.default_rng(seed)

    def learn(some):
        nonlocal bias, gb
        for i in rng.permutation(len(some)):
            index, value, lang = some[i]
            y = code[place[lang]]
            g = -y / (1 + np.exp(np.clip(y * (value @ w[index] + bias), -30, 30)))
            step = value[:, None] * g[None, :].astype(np.float32)
            gw[index] += step * step
            w[index] -= rate * step / np.sqrt(gw[index])
            gb += (g * g).astype(np.float32)
            bias = (bias - rate * g / np.sqrt(gb)).astype(np.float32)

    back, rest = rows[::10], [r for i, r in enumerate(rows) if i % 10]
    for _ in range(epochs):
        learn(rest)
    right = np.array([(value @ w[index] + bias) * code[place[lang]] > 0 for index, value, lang in back])
    accuracy = right.mean(axis=0) if n_bits else np.zeros(0)
    learn(back)
    bit_weights = np.maximum(accuracy, 1e-3)
    return Ecoc(languages, code, w, bias, bit_weights / max(1e-9, bit_weights.sum()) * max(1, n_bits))


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [features(t.as_py() or "") for t in b.column(2)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([m[0] for m in made], pa.list_(pa.int32())),
             pa.array([m[1] for m in made], pa.list_(pa.float32()))], names=["order", "lang", "index", "value"])


def _fit_task(epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for o, lang, i, v in zip(*(b.column(c) for c in range(4))):
                rows.append((o.as_py(), lang.as_py(), i.values.to_numpy(), v.values.to_numpy()))
        if rows:
            rows.sort(key=lambda r: (r[0], r[1], len(r[2]), r[3].tobytes()))
            model = fit([(i, v, lang) for _, lang, i, v in rows], epochs)
            yield pa.RecordBatch.from_arrays([pa.array([model.dumps()])], names=["model"])
    return run


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = PER_LANGUAGE, epochs: int = EPOCHS) -> Ecoc | None:
    """Fit on at most ``per_language`` documents of each language outside the held-out fold."""
    known = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()) \
        .select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.xxhash64(id_col).alias("_order")).distinct()
    known = materialize(known, "langid-ids")
    # the smallest hashes of a language lie far below 3 per_language / n; only those are ranked, or all where too few do
    # (counts has one row per language, as many as the sample has groups)
    counts = known.groupBy(F.col("_lang").alias("_l")).agg(F.count(F.lit(1)).alias("_c"))
    share = F.col("_order").cast("double") / 2.0**64 + 0.5
    known = known.join(F.broadcast(counts), F.col("_lang") == F.col("_l")) \
        .select("_id", "_lang", "_order", (share * F.col("_c") <= 3 * per_language).alias("_near"))
    enough = known.groupBy(F.col("_lang").alias("_l")).agg((F.count_if("_near") >= per_language).alias("_enough"))
    known = known.join(F.broadcast(enough), F.col("_lang") == F.col("_l")).where(F.col("_near") | ~F.col("_enough")) \
        .select("_id", "_lang", "_order")
    w = Window.partitionBy("_lang").orderBy("_order", "_id")
    sample = known.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_language) \
        .select("_id", "_lang", "_order")
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(lang_col).alias("_l"), F.col(text_col).alias("_text"))
    joined = texts.join(F.broadcast(sample), (F.col("_doc") == F.col("_id")) & (F.col("_l") == F.col("_lang")))
    joined = joined.where(F.col("_text").isNotNull()).groupBy("_id", "_order", "_lang").agg(F.min("_text").alias("_text"))
    made = joined.select("_order", "_lang", "_text").mapInArrow(  # one row per id
        _featurize, "order bigint, lang string, index array<int>, value array<float>")
    row = made.repartition(1).mapInArrow(_fit_task(epochs), "model binary").first()
    return row and Ecoc.loads(bytes(row["model"]))


def identify(docs: DataFrame, model: Ecoc | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, held_out, lang_pred, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast((model or Ecoc(
        [], np.ones((0, 0)), np.zeros((SIZE, 0), np.float32), np.zeros(0), np.zeros(0))).dumps())

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Ecoc.loads(shared.value)
        for part in texts:
            yield pd.DataFrame([m.predict(t) for t in part], columns=["lang_pred", "score", "ambiguous"])

    out = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), predict(F.col(text_col)).alias("p"))
    return out.select(F.col("id").alias(id_col), "held_out", "p.lang_pred", F.round("p.score", 6).alias("score"),
                      "p.ambiguous")
