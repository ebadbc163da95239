import hashlib
import re

import pytest
from helpers import WORDS, awkward, empty, prose

from shopfloor.llm.decontaminate import benchmark_windows, contamination, drop_contaminated, window_hits

RX = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return RX.findall((t or "").translate(LOWER))


def brute(text, items, n=13):
    ws, hit, found, windows = words(text), set(), set(), {}
    for item, body in items:
        iw = words(body)
        for a in range(max(1, len(iw) - n + 1) if iw else 0):
            windows.setdefault(tuple(iw[a:a + n]), set()).add(str(item))
    for size in {len(w) for w in windows}:
        for p in range(len(ws) - size + 1):
            if (w := tuple(ws[p:p + size])) in windows:
                hit.update(range(p, p + size))
                found |= windows[w]
    names = ",".join(sorted(found))
    return len(ws), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)


ITEMS = [(1, prose(100, 30)), (2, "Short ITEM"), (3, "alpha1"), (4, None), (5, "... !!"), (6, prose(100, 30)),
         (7, prose(101, 13)), (None, prose(102, 14)), (8, "three word item"), (7, prose(101, 13))]


@pytest.mark.parametrize("block_bytes", [64 << 20, 400])
def test_equals_brute_force(spark, block_bytes):
    p = prose(100, 30)
    more = [(20, "x " * 50 + p + " y"), (21, "A SHORT, item! and more"), (22, p.replace(" ", "  ").upper()),
            (23, " ".join(p.split()[:12])), (24, "three word item three word item"), (25, prose(101, 13) + " " + prose(102, 14)),
            (26, " ".join(WORDS) + " alpha1 " + prose(7, 300))]
    df = awkward(spark, more).repartition(4)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    named = [(i, t) for i, t in ITEMS if i is not None] + [("", ITEMS[7][1])]
    got = {(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in contamination(df, bench, block_bytes=block_bytes).collect()}
    want = set()
    for r in df.select("doc_id", "text").collect():
        b = brute(r.text, named)
        want.add((r.doc_id, b[0], b[1], b[4]))
    assert got == want
    full = {r.doc_id: r for r in contamination(df, bench.where("item_id is not null"), block_bytes=block_bytes).collect()}
    for r in df.where("doc_id > 8").select("doc_id", "text").collect():
        x = full[r.doc_id]
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) == brute(r.text, [i for i in ITEMS if i[0] is not None])


def test_empty_tables(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(empty(spark), bench).collect() == []
    out = contamination(awkward(spark), none).collect()
    assert len(out) == 15 and not any(r.contaminated for r in out)


def test_drop_keeps_columns_and_clean_rows(spark):
    df = awkward(spark, [(20, prose(100, 30)), (20, prose(100, 30)), (20, "clean text under the same id")])
    bench = spark.createDataFrame([(1, prose(100, 30))], "item_id long, text string")
    out = drop_contaminated(df, bench)
    assert out.columns == df.columns
    assert out.count() == df.count() - 2
    assert [r.text for r in out.where("doc_id = 20").collect()] == ["clean text under the same id"]


def test_windows_and_scan_are_join_free_of_products(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = window_hits(awkward(spark), "doc_id", "text", benchmark_windows(bench, "item_id", "text", 13)) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_many_windows_with_one_beginning(spark):
    """Question benchmarks begin alike: every position with that beginning is looked up by its whole wording."""
    same = [(k, "which of the " + prose(1000 + k, 12)) for k in range(300)] + [(900, "which of the"), (901, "which of")]
    docs = [(k, "so which of the " + prose(1000 + 3 * k, 12) + " which of the which of the rest " + prose(k, 9)) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(same, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(df, bench).collect()}
    assert got == {i: brute(t, same) for i, t in docs}
