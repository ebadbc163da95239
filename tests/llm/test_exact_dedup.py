import hashlib

from helpers import awkward, empty, rows

from shopfloor.llm.exact_dedup import digest_runs, exact_dedup, tree_merge


def brute(data):
    groups = {}
    for i, t in data:
        groups.setdefault(t or "", []).append(i)
    return groups


def test_awkward_rows(spark):
    df = awkward(spark).repartition(5)
    data = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    groups = brute(data)
    got = exact_dedup(df).collect()
    assert len(got) == len(data)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (max(known) if known else None)
    kept = [r.text_sha256 for r in got if r.kept]
    assert sorted(kept) == sorted(by_sha)  # one row of every group, also where id and text repeat


def test_hot_digest_and_round_shapes_agree(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"t{i % 40}") for i in range(3000)], "doc_id long, text string") \
        .repartition(40)
    a = rows(exact_dedup(df), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    for bits, n in ((1, 6), (2, 3), (6, 1)):
        assert rows(exact_dedup(df, fan_in_bits=bits, rounds=n), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == a
    assert sum(r[3] for r in a) == 41 - 0 if len({t for _, _, _, k, t in a if k}) == 41 else len({r[4] for r in a})
    merged = tree_merge(digest_runs(df, "doc_id", "text"), 3, 3)
    assert merged.count() == len({r[4] for r in a})


def test_empty(spark):
    assert exact_dedup(empty(spark)).collect() == []
