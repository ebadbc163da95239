import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import pytest
from helpers import awkward, empty, prose

from shopfloor.llm import sharding as S


def one_by_one(sizes, capacity):
    """Best fit decreasing, a group at a time, with a sorted list."""
    free, loads = [], []
    for size in sorted(sizes, reverse=True):
        at = bisect_left(free, (size, -1))
        rest, b = free.pop(at) if at < len(free) else (capacity, len(loads))
        if b == len(loads):
            loads.append(0)
        loads[b] += size
        if rest - size > 0:
            insort(free, (rest - size, b))
    return loads


def test_classes_pack_like_single_groups():
    r = random.Random(5)
    for _ in range(200):
        sizes = [r.choice([3, 7, 7, 11, r.randrange(1, 40), r.randrange(1, 200)]) for _ in range(r.randrange(1, 120))]
        capacity = r.randrange(60, 260)
        classes = sorted(Counter(sizes).items(), reverse=True)
        runs, loads = S.best_fit(classes, capacity)
        assert loads == one_by_one(sizes, capacity)
        assert Counter({s: n for s, n in classes}) == sum((Counter({s: n}) for s, _, n in runs), Counter())
        assert all(x <= capacity for x in loads if x not in sizes)


def test_tree_is_a_sorted_set():
    r, tree, kept = random.Random(2), S.CapacityTree(), set()
    for step in range(4000):
        key = (r.randrange(300), r.randrange(30))
        if key in kept:
            tree.remove(key)
            kept.remove(key)
        else:
            tree.add(key)
            kept.add(key)
        if step % 7 == 0:
            size = r.randrange(320)
            assert tree.tightest(size) == min((k for k in kept if k[0] >= size), default=None)

    def depth(n):
        return 0 if n is None else 1 + max(depth(n[1]), depth(n[2]))
    assert depth(tree.root) < 60


def test_levels_and_oversized_groups():
    r = random.Random(8)
    sizes = [r.randrange(9, 3000) for _ in range(5000)]
    classes = sorted(Counter(sizes).items(), reverse=True)
    runs, loads = S.level_bins(classes, 24)
    assert len(loads) == 24 and sum(loads) == sum(sizes) and max(loads) - min(loads) < 0.002 * sum(sizes) / 24
    hot = sum(sizes) // 2
    runs, loads = S.level_bins([(hot, 1), *classes], 24)
    rest = sorted(loads)[:-1]
    assert max(loads) == hot and len(loads) == 24 and max(rest) - min(rest) < 0.002 * sum(rest) / 23
    assert S.level_bins([(5, 2)], 24)[1] == [5, 5] and S.level_bins([], 24) == ([], [])


def check(df, got, shards):
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.id, r.size, r.text_crc32) for r in got) == want
    home, slots = defaultdict(set), defaultdict(list)
    for r in got:
        assert 0 <= r.shard < shards
        home[r.size, r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in home.values())  # equal texts stay together
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return Counter(r.shard for r in got for _ in range(r.size))


def test_awkward_rows(spark):
    df = awkward(spark).repartition(3)
    check(df, S.assign_shards(df, 4).collect(), 4)
    assert S.assign_shards(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        S.assign_shards(df, 4, 100)


def test_hot_group_and_equal_sizes(spark):
    """A third of the rows are one text; the others share few sizes."""
    data = [(i, "the same text" if i % 3 == 0 else f"{i:06d} " + "x" * (i % 5)) for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(9)
    loads = sorted(check(df, S.assign_shards(df, 12).collect(), 12).values())
    assert len(loads) == 12 and loads[-2] - loads[0] <= 40 and loads[-1] == 1000 * 21


def test_fixed_capacity_uses_few_shards(spark):
    df = spark.createDataFrame([(i, prose(i, 5 + i % 40)) for i in range(400)], "doc_id long, text string")
    got = S.assign_shards(df, None, 20_000).collect()
    loads = check(df, got, 10_000)
    assert max(loads.values()) <= 20_000 and len(loads) <= -(-sum(loads.values()) // 20_000) + 1


def test_written_shards(spark, tmp_path):
    df = awkward(spark)
    back = S.write_shards(df, str(tmp_path / "shards"), 3, rows_per_file=4)
    assert set(back.columns) == {*df.columns, "shard", "slot"}
    assert sorted(map(str, back.select(df.columns).collect())) == sorted(map(str, df.collect()))
    planned = sorted((str(r.id), r.size, r.shard) for r in S.assign_shards(df, 3).collect())
    stored = sorted((str(r.doc_id), len((r.text or "").encode()) + 8, r.shard) for r in back.collect())
    assert planned == stored
