import re
from itertools import permutations

from helpers import awkward, empty, prose

from shopfloor.llm import filter_audit as A

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
LABELS = "doc_id long, quality int, toxic int, id string"


def fails(rows):
    first = {}
    for r in rows:
        if r.doc_id is not None:
            first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    out = []
    for r in rows:
        t = r.text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append({"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                    "D": bool(re.search(r"[#$%&*|]", t)), "E": r.doc_id is not None and r.doc_id > first[t]})
    return out


def brute(rows, labels):
    good = {i for i, q, _, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, _ in labels if t == 1 and i is not None}
    bad, out = fails(rows), []
    for part in {r.source or "" for r in rows}:
        own = [k for k, r in enumerate(rows) if (r.source or "") == part]
        shapley, some = {}, []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [k for k in left if bad[k][f]]
                left = [k for k in left if not bad[k][f]]
                shapley[f] = shapley.get(f, 0) + len(gone)
                some.append([part, "".join(order), step, len(left), len(gone), sum(bad[k][f] for k in own) - len(gone),
                             sum(sum(bad[k].values()) == 1 and bad[k][f] for k in own),
                             sum(rows[k].doc_id in good for k in gone), sum(rows[k].doc_id in toxic for k in gone)])
        out += [tuple([*s, shapley[s[1][s[2] - 1]]]) for s in some]
    return sorted(out)


def test_equals_brute_force(spark):
    long_ok = " ".join(f"w{i}" for i in range(300))
    more = [(20 + k, t) for k, t in enumerate([long_ok, long_ok, long_ok + " #", long_ok.upper(), "a b " * 150, "A B # " * 150,
                                               prose(3, 260), prose(3, 260), "X" * 30, "50 %", "é" * 300, "\x0b\x0c\x1c\x85 a"])]
    df = awkward(spark, more).repartition(4)
    labels = [(20, 1, 0, "x"), (21, 1, 1, "x"), (21, 0, 0, "x"), (22, None, 1, None), (6, 1, None, "x"), (7, 1, 1, "x"),
              (None, 1, 1, "x"), (999, 1, 1, "x"), (24, 0, 1, "x"), (8, 1, 0, "y")]
    rows = df.collect()
    got = sorted(tuple(r) for r in A.audit(df, spark.createDataFrame(labels, LABELS)).select(COLUMNS).collect())
    assert got == brute(rows, labels)


def test_hot_copies_and_clean_rows(spark):
    """A third of all rows equal; parts whose rows fail nothing appear with zeros."""
    ok = " ".join(f"w{i}" for i in range(250))
    data = [(i, ok if i % 3 == 0 else f"{ok} n{i}", "s1" if i < 200 else "s2") for i in range(300)] + [(999, f"{ok} last", "only clean")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(7)
    got = {(r.part, r.filter_order, r.step): r for r in A.audit(df, spark.createDataFrame([], LABELS)).collect()}
    assert len(got) == 3 * 600
    r = got["s2", "ABCDE", 5]
    assert (r.kept, r.removed, r.unique_fails, r.shapley) == (67, 33, 33, 33 * 120)
    assert got["only clean", "EDCBA", 5].kept == 1 and got["only clean", "EDCBA", 1].removed == 0


def test_removed_plus_kept_is_kept_before(spark):
    df = awkward(spark)
    got = {(r.part, r.filter_order, r.step): r for r in A.audit(df, spark.createDataFrame([], LABELS)).collect()}
    for (part, order, step), r in got.items():
        if step > 1:
            assert got[part, order, step - 1].kept == r.kept + r.removed


def test_empty_and_other_filters(spark):
    labels = spark.createDataFrame([], LABELS)
    assert A.audit(empty(spark), labels).collect() == []
    two = A.audit(awkward(spark), labels, {"X": "words = 0", "Y": "bytes < 5"})
    assert two.count() == 4 * 2 * 2 and set(r.filter_order for r in two.collect()) == {"XY", "YX"}
