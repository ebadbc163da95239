import pytest
from helpers import awkward, empty, prose, rows

from shopfloor.llm.mixing import mix, repeat_to_mix


def water_fill(sizes):
    """sizes: source -> words, in weight order."""
    total, capped = sum(sizes.values()), set()
    w = {s: 1 + k % 3 for k, s in enumerate(sizes)}
    while True:
        free = [s for s in sizes if s not in capped]
        lam = (total - sum(3 * sizes[s] for s in capped)) / sum(w[s] for s in free) if free else 0
        new = {s for s in sizes if 3 * sizes[s] < lam * w[s]}
        if new == capped:
            return {s: min(3 * sizes[s], lam * w[s]) for s in sizes}
        capped = new


def test_targets_and_taken(spark):
    import random

    r = random.Random(5)
    data = [(i, prose(i, r.randint(1, 80)), f"s{r.choice([0, 0, 0, 0, 0, 1, 2, 3, 4])}" if i % 11 else None) for i in range(900)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(6)
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = water_fill({s: sizes[s] for s in order})
    got = mix(df).collect()
    assert len(got) == len(data)
    source = {i: s for i, _, s in data}
    taken = {}
    for x in got:
        s = source[x.doc_id]
        assert x.target == pytest.approx(want[s], rel=1e-12) and x.source_size == sizes[s]
        assert 0 <= x.taken <= 3 * x["size"] and x.taken == x.copies * x["size"]
        taken[s] = taken.get(s, 0) + x.taken
    for s in want:
        assert taken[s] == pytest.approx(want[s], rel=0.01)
    assert rows(mix(df.repartition(3)), "doc_id", "taken") == sorted((x.doc_id, x.taken) for x in got)


def test_hot_class_of_equal_sizes(spark):
    df = spark.createDataFrame([(i, "five words in this text", "a" if i < 400 else "b") for i in range(1000)],
                               "doc_id long, text string, source string")
    got = mix(df).collect()
    for s, ids in (("a", range(400)), ("b", range(400, 1000))):
        some = [x for x in got if x.doc_id in ids]
        assert abs(sum(x.taken for x in some) - some[0].target) <= 5


def test_awkward_rows(spark):
    df = awkward(spark)
    got = mix(df).collect()
    assert len(got) == df.count()
    assert all(x["size"] == 0 and x.taken == 0 for x in got if x.doc_id in (1, 2, 3))
    out = repeat_to_mix(df)
    assert out.columns == df.columns
    assert out.where("doc_id is not null").count() == sum(x.copies for x in got if x.doc_id is not None)
    assert out.count() == sum(x.copies for x in got)


def test_repeated_rows_share_copies(spark):
    df = spark.createDataFrame([(1, "a b c", "s")] * 7 + [(2, "d e", "t")] * 2, "doc_id long, text string, source string")
    assert repeat_to_mix(df).count() == sum(x.copies for x in mix(df).collect())


def test_no_words_at_all_and_empty(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "s")], "doc_id long, text string, source string")
    assert [(x["size"], x.target, x.taken) for x in mix(df).collect()] == [(0, 0.0, 0)] * 2
    assert mix(empty(spark)).collect() == []
    assert repeat_to_mix(empty(spark)).collect() == []
