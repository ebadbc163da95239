import random
import re

import numpy as np
import pytest
import xxhash
from helpers import awkward, empty, prose

from shopfloor.llm.simhash import (GOLAY_BITS, GOLAY_RADIUS, components, drop_near_duplicates, fingerprint, golay_words,
                                   links, near_dedup)


def plain(text, k=3):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i:i + k]).encode(), 42) for i in range(max(1, len(ws) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(fps, bits=2):
    """Component (least index) of every fingerprint, by brute force."""
    a, parent = np.array(fps, np.uint64), list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= bits):
            x, y = find(i), find(i + 1 + int(j))
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def test_fingerprint_equals_plain():
    for t in ["", " \t\x0b\x0c", "One", "one two", "A b C d", "É é x y", prose(1, 700), "\x1cx \x85y z", "a a a a a a"]:
        assert fingerprint(t.encode()) == plain(t), t


def test_golay_code_covers_with_radius_three():
    words = golay_words()
    assert len(set(words.tolist())) == 4096 and int(words.max()) < 1 << GOLAY_BITS
    r = np.random.default_rng(0)
    for v in r.integers(0, 1 << GOLAY_BITS, 300, dtype=np.uint32):
        assert (np.bitwise_count(words ^ v) <= GOLAY_RADIUS).sum() == 1  # perfect: exactly one centre


def test_links_equal_brute_force(spark):
    r = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        x = r.getrandbits(64)
        for _ in range(8):
            fps.add(x)
            for _ in range(r.randint(1, 3)):
                x ^= 1 << r.randrange(64)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {(a % (1 << 64), b % (1 << 64)) for a, b in links(df).collect()}
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if (a ^ b).bit_count() <= 2}
    assert {tuple(sorted(p)) for p in got} == want and len(got) == links(df).count()


@pytest.mark.parametrize("shape", ["chain", "star", "none"])
def test_components(spark, shape):
    edges = {"chain": [(i, i + 1) for i in range(1, 70)], "star": [(1, i) for i in range(2, 60)], "none": []}[shape]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {n: 1 for e in edges for n in e}


def test_awkward_rows(spark):
    near = prose(50, 400)
    df = awkward(spark, [(40, near), (41, near + " tail"), (3, near)]).repartition(4)
    data = sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0))
    fps = [plain(t) for _, t in data]
    root = roots(fps)
    want = sorted((str(i), f"{f:016x}", str(data[k][0])) for (i, _), f, k in zip(data, fps, root))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in near_dedup(df).collect())
    assert got == want
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(plain(r.text) for r in out.collect()) == sorted(plain(data[k][1]) for k in set(root))
    assert {r.doc_id for r in out.collect()} == {data[k][0] for k in set(root)}


def test_empty(spark):
    assert near_dedup(empty(spark)).collect() == [] and drop_near_duplicates(empty(spark)).collect() == []
