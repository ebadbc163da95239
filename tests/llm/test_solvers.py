"""Decoding and dual solving against plain loops."""

import math

import numpy as np
import pytest

from shopfloor.llm import langid as L
from shopfloor.llm import mixing as M


@pytest.mark.parametrize("k", [2, 4, 9])
def test_decoding_picks_the_codeword_of_least_weighted_loss(k):
    rng = np.random.default_rng(k)
    code = L.codewords(k)
    bits = code.shape[1]
    model = L.Ecoc([f"l{i}" for i in range(k)], code, rng.normal(size=(L.SIZE, bits)).astype(np.float32),
                   rng.normal(size=bits).astype(np.float32), rng.uniform(0.1, 2, size=bits))
    for text in ("one two three", "Ünï cödé", "x" * 300, "a b a b"):
        index, value = L.features(text)
        margin = [sum(float(v) * float(model.weights[i, j]) for i, v in zip(index, value)) + float(model.bias[j]) for j in range(bits)]
        loss = [sum(model.bit_weights[j] * math.log1p(math.exp(-int(code[c, j]) * margin[j])) for j in range(bits)) for c in range(k)]
        share = [math.exp(min(loss) - x) for x in loss]
        name, score, unsure = model.predict(text)
        assert name == f"l{loss.index(min(loss))}"
        assert abs(score - max(share) / sum(share)) < 1e-4 and unsure == (score < L.AMBIGUOUS)


def test_flipped_bits_still_decode():
    """Errors on fewer than half the least distance between codewords leave the language right."""
    for k in (5, 12):
        code = L.codewords(k)
        apart = min(int((code[a] != code[b]).sum()) for a in range(k) for b in range(a))
        wrong = (apart - 1) // 2
        rng = np.random.default_rng(1)
        for c in range(k):
            seen = code[c].astype(float) * 4
            seen[rng.permutation(len(seen))[:wrong]] *= -1
            model = L.Ecoc([str(i) for i in range(k)], code, np.zeros((L.SIZE, len(seen)), np.float32), seen, np.ones(len(seen)))
            assert model.predict("some text")[0] == str(c)


def test_multipliers_equal_a_scalar_solver(spark):
    rng = np.random.default_rng(2)
    cap, hist, sources, want = 3.0, [], [], {}
    for sid in range(12):
        sizes = sorted(set(rng.integers(1, 400, size=30).tolist()))
        counts = rng.integers(1, 50, size=len(sizes)).tolist()
        total, docs = sum(s * n for s, n in zip(sizes, counts)), sum(counts)
        target = float(total) * float(rng.uniform(0.05, 2.9))
        hist += [(sid, s, n) for s, n in zip(sizes, counts)]
        sources.append((sid, total, docs, float(sum(n * s * s for s, n in zip(sizes, counts))), min(sizes), target))
        mean = total / docs

        def mass(lam, sizes=sizes, counts=counts, mean=mean):
            return sum(n * s * min(cap, math.exp(min(50.0, lam * s / mean))) for s, n in zip(sizes, counts))
        lo, hi = -200.0, 200.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if mass(mid) < target else (lo, mid)
        want[sid] = (lo, mean, target, mass)
    h = spark.createDataFrame(hist, "sid long, size long, n long")
    s = spark.createDataFrame(sources, "sid long, total long, docs long, square double, smallest long, target double")
    M_rows = M.tilt(h, s, cap).collect()
    assert {r.sid for r in M_rows} == set(want)
    for r in M_rows:
        lam, mean, target, mass = want[r.sid]
        assert abs(r["mean"] - mean) < 1e-9 and abs(r.lam - lam) <= 1e-5 * max(1.0, abs(lam))
        assert abs(mass(r.lam) - target) <= 1e-6 * target
