import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from helpers import WORDS, awkward, empty, prose

from shopfloor.llm import importance as I
from shopfloor.session import materialize

COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def features(text, max_run):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return ws, [zlib.crc32(" ".join(ws[i:i + k]).encode()) for k in range(1, max_run + 1) for i in range(len(ws) - k + 1)]


def brute(docs, target, max_run=1, buckets=10_000, seed=2024, min_words=20, percent=10):
    own = [(i, *features(t, max_run)) for i, t in docs]
    s, t = Counter(f % buckets for _, _, fs in own for f in fs), Counter(f % buckets for x in target for f in features(x, max_run)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, ws, fs in own:
        weight = math.floor(sum(gain[f % buckets] for f in fs) / len(fs)) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(ws)])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[:len(able) * percent // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def test_equals_brute_force_on_awkward_rows(spark):
    r = random.Random(3)
    more = [(100 + k, " ".join(r.choice(WORDS) for _ in range(r.randrange(15, 60)))) for k in range(200)] + [(-5, prose(9, 25))] * 3
    df = awkward(spark, more).repartition(5)
    docs = [(x.doc_id, x.text) for x in df.select("doc_id", "text").collect()]
    goal = [prose(7, 50), None, "Gamma DELTA gamma", "日本語 Ünï"]
    target = spark.createDataFrame([(t, 1) for t in goal], "text string, doc_id int")
    for options in ({}, {"max_run": 2, "buckets": 97, "percent": 37, "seed": 5, "min_words": 1}):
        assert got(I.resample(df, target, **options)) == brute(docs, goal, **options)


def test_radix_order_equals_sort(spark):
    r = random.Random(1)
    ids = [r.choice([None, r.randrange(-2**63, 2**63), r.randrange(40)]) for _ in range(900)]
    data = [(k, i, r.choice([7, 7, 7, r.randrange(-5000, 5000)])) for k, i in enumerate(ids)]
    rows = materialize(spark.createDataFrame(data, "k long, id long, score long").repartition(6)
                       .withColumn("row", __import__("pyspark.sql.functions", fromlist=["x"]).monotonically_increasing_id()), "test")
    for bits, block in ((11, 1 << 20), (3, 50)):
        pos = I.radix_rank(rows, digit_bits=bits, block_rows=block).collect()
        assert sorted(p.pos for p in pos) == list(range(len(data)))
        order = sorted(pos, key=lambda p: (-p.score, p.id is None, p.id or 0, p.pos))
        assert [p.pos for p in order] == list(range(len(data)))


def test_radix_hot_keys_are_stable(spark):
    rows = materialize(spark.range(500).selectExpr("id % 2 as id", "1L as score", "id as k", "monotonically_increasing_id() as row"), "t")
    pos = sorted(I.radix_rank(rows, block_rows=16).collect(), key=lambda p: p.pos)
    assert [(p.id, p.row) for p in pos] == sorted((p.id, p.row) for p in pos)


def test_empty_tables_and_draw(spark):
    goal = spark.createDataFrame([], "text string")
    assert I.resample(empty(spark), goal).collect() == []
    df = spark.createDataFrame([(k, prose(k, 30), "x") for k in range(50)], "doc_id long, text string, row string")
    drawn = I.draw_documents(df, goal)
    assert drawn.columns == df.columns and drawn.count() == 5


def test_target_texts_are_drawn_first(spark):
    """Documents in the target's words rank high: noise moves a score by a few thousand, words by more."""
    near = [(k, " ".join(["rareone raretwo rarethree"] * 10)) for k in range(30)]
    far = [(100 + k, prose(k, 30)) for k in range(270)]
    df = spark.createDataFrame(near + far, "doc_id long, text string")
    goal = spark.createDataFrame([("rareone raretwo rarethree " * 2000,)], "text string")
    ranks = {r.doc_id for r in I.resample(df, goal).where("rank is not null").collect()}
    assert len(ranks) == 30 and len([i for i in ranks if i < 30]) >= 20


def test_gains_and_words():
    assert I.words_of("A-b_C ß9\x7fÉx") == ["a".encode(), b"b", b"c", "ß9".encode(), "Éx".encode()]
    gains = I.bucket_gains(np.array([0, 5]), np.array([9, 0]))
    assert gains.tolist() == [math.floor(1000 * math.log(11 / 70)), math.floor(1000 * math.log(6 * 11 / 7))]
