"""The ordinal fit against a plain solver, and its bounded sample."""

import numpy as np
from helpers import prose

from shopfloor.llm import quality as Q


def likelihood(w, th, rows):
    total = 0.0
    for index, value, g in rows:
        p = np.concatenate(([0.0], 1 / (1 + np.exp(-(th - w[index] @ value))), [1.0]))
        total += np.log(max(p[g + 1] - p[g], 1e-12))
    return total / len(rows)


def plain_solver(rows, size, grades, steps=4000, rate=0.5):
    """Full-batch gradient ascent with numeric checks left out: weights and ordered thresholds."""
    x = np.zeros((len(rows), size))
    for k, (index, value, _) in enumerate(rows):
        x[k, index] = value
    g = np.array([r[2] for r in rows])
    w, th = np.zeros(size), np.linspace(-1, 1, grades - 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(th[None, :] - (x @ w)[:, None])))
        full = np.hstack((np.zeros((len(g), 1)), p, np.ones((len(g), 1))))
        at = np.arange(len(g))
        high, low = full[at, g + 1], full[at, g]
        likely = np.maximum(high - low, 1e-9)
        up, down = high * (1 - high) / likely, low * (1 - low) / likely
        w -= rate * ((up - down)[:, None] * x).mean(axis=0)
        move = np.zeros(grades - 1)
        for k in range(grades - 1):
            move[k] = (up[g == k].sum() - down[g == k + 1].sum()) / len(g)
        th = np.sort(th + rate * move)
    return w, th


def test_fit_reaches_the_likelihood_of_a_plain_solver():
    rng = np.random.default_rng(3)
    true = rng.normal(size=6)
    rows = []
    for _ in range(400):
        x = rng.normal(size=6).astype(np.float32)
        g = int(np.digitize(x @ true + rng.logistic(), (-1.0, 1.5)))
        rows.append((np.arange(6), x, g))
    w, th = plain_solver(rows, 6, 3)
    m = Q.fit(rows, 3, epochs=150, rate=0.1)
    best, ours = likelihood(w, th, rows), likelihood(m.weights.astype(float), m.thresholds, rows)
    assert best - 0.02 < ours <= best + 0.005
    assert (np.diff(m.thresholds) >= 0).all()


def test_sample_is_bounded_when_ids_repeat(spark):
    """One id on 3,000 rows is one row of the fit for each of its grades."""
    docs = spark.createDataFrame([(i, prose(i, 8)) for i in range(60)] + [(7, prose(k, 5)) for k in range(3000)],
                                 "doc_id long, text string").repartition(6)
    ratings = spark.createDataFrame([(i, i % 3) for i in range(60)] + [(7, 0), (7, 2), (7, 2), (None, 1), (3, None)],
                                    "doc_id long, grade int")
    whole = Q.training_rows(docs, ratings, "doc_id", "text", "grade", 3, 1000).collect()
    assert len(whole) == 62
    texts = [bytes(r.text).decode() for r in whole]
    assert texts.count(min([prose(7, 8)] + [prose(k, 5) for k in range(3000)])) == 3  # its three grades
    assert Q.training_rows(docs, ratings, "doc_id", "text", "grade", 3, 40).count() == 40
    a, b = Q.train(docs, ratings), Q.train(docs.repartition(3), ratings)
    assert (a.weights == b.weights).all() and a.cut == b.cut


def test_rows_of_one_place_are_ordered_by_their_values():
    """The same order as by (order, grade, size, bytes of the values), without copying the values of every row."""
    from itertools import groupby

    import numpy as np

    from shopfloor.llm.quality import _by_values, _place

    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(4)), int(rng.integers(2)), np.arange(n), rng.random(n).astype(np.float32))
            for n in rng.integers(1, 4, 200)]
    want = sorted(rows, key=lambda r: (*_place(r), r[3].tobytes()))
    got = [r for _, same in groupby(sorted(rows, key=_place), _place) for r in _by_values(list(same))]
    assert [id(r) for r in got] == [id(r) for r in want]


def test_texts_are_read_in_small_batches(spark, monkeypatch):
    """Fitting's and SimHash's Python workers get some MB of text at a time, not 10,000 rows."""
    from shopfloor.llm import quality, simhash
    from shopfloor.session import INPUT_BYTES

    def checked(run, limit=2 * INPUT_BYTES):
        def each(batches):
            for b in batches:
                assert b.nbytes < limit, b.nbytes
                yield from run(iter([b]))
        return each
    docs = spark.range(40).selectExpr("id AS doc_id", "concat(id, repeat(' some words', 40000)) AS text").coalesce(1)
    monkeypatch.setattr(quality, "_featurize", checked(quality._featurize))
    assert quality.train(docs, spark.range(40).selectExpr("id AS doc_id", "int(id % 3) AS grade")) is not None
    fingerprints = checked(simhash._fingerprints(3))
    monkeypatch.setattr(simhash, "_fingerprints", lambda _: fingerprints)
    assert simhash.classify(docs, "doc_id", "text", 3, 2)[0].count() == 40
