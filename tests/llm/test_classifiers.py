import random
import zlib

import numpy as np
import pytest
from helpers import awkward, empty

from shopfloor.llm import langid, quality

SF = "/root/testdata/sf0.01"


def test_cumulative_link_learns_ordered_grades():
    r = random.Random(0)
    rows = []
    for _ in range(900):
        g = r.randrange(4)
        words = [r.choice("abcdefghij") * 3 for _ in range(20)] + ["good"] * (3 * g)
        rows.append((*quality.features(" ".join(words).encode()), g))
    m = quality.fit(rows[:700], 4)
    assert (np.diff(m.thresholds) >= 0).all()
    s = np.array([float(m.weights[i] @ v) for i, v, _ in rows[700:]])
    p = m.at_most(s)
    assert (np.diff(p, axis=1) >= 0).all()
    expected, g = (1 - p).sum(axis=1), np.array([x[2] for x in rows[700:]])
    assert np.abs(expected - g).mean() < 0.35


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    grades = quality.label_grades(labels)
    fold = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"
    model = quality.train(docs, grades.where(f"not ({fold})"))
    got = quality.rate_documents(docs, model).join(grades.where(fold), "doc_id").collect()
    good, low = [r.kept for r in got if r.grade == 2], [r.kept for r in got if r.grade == 0]
    assert sum(good) >= 0.95 * len(good) and sum(low) <= 0.2 * len(low)
    again = quality.train(docs.repartition(7), grades.where(f"not ({fold})").repartition(3))
    assert (again.weights == model.weights).all() and again.cut == model.cut and (again.thresholds == model.thresholds).all()
    assert quality.select_quality(docs, model).count() == quality.rate_documents(docs, model).where("kept").count()


def test_quality_awkward_rows(spark):
    df = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = quality.train(df, none)
    assert model is None and all(r.kept and r.tail_probability is None for r in quality.rate_documents(df, model).collect())
    rated = spark.createDataFrame([(1, 0), (6, 2), (9, 2), (9, 1), (5, None), (None, 1), (4, 99), (12, 1)], "doc_id long, grade int")
    model = quality.train(df, rated)
    out = quality.rate_documents(df, model).collect()
    assert len(out) == df.count() and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in out)
    assert quality.select_quality(df, model).columns == df.columns
    assert quality.rate_documents(empty(spark), model).collect() == []


def test_features_of_slices_equal_whole(monkeypatch):
    text = " ".join(f"w{i % 300} Zürich" for i in range(3000))
    a, b = quality.features(text.encode()), langid.features(text)
    monkeypatch.setattr(quality, "SLICE", 257)
    monkeypatch.setattr(langid, "SLICE", 257)
    c, d = quality.features(text.encode()), langid.features(text)
    assert (a[0] == c[0]).all() and np.allclose(a[1], c[1]) and (b[0] == d[0]).all() and np.allclose(b[1], d[1])


@pytest.mark.parametrize("k", [0, 1, 2, 3, 4, 6, 7, 12, 40])
def test_codewords_are_apart(k):
    code = langid.codewords(k)
    assert code.shape[0] == k
    for i in range(k):
        for j in range(i):
            assert (code[i] != code[j]).sum() >= (code.shape[1] + 1) // 2 * (k <= 6) + (k > 6) * code.shape[1] // 5
    for column in code.T:
        assert len(set(column.tolist())) == 2


def test_many_languages():
    r = random.Random(1)
    stems = {f"l{i:02d}": [f"{c}{d}" for c in "bcdfghklmnprstvz"[i:i + 4] for d in "aeiou"] for i in range(10)}
    rows = [(*langid.features(" ".join("".join(r.choice(s) for _ in range(3)) for _ in range(40))), lang)
            for lang, s in stems.items() for _ in range(40)]
    m = langid.fit(rows)
    hits = 0
    for lang, s in stems.items():
        for _ in range(10):
            hits += m.predict(" ".join("".join(r.choice(s) for _ in range(3)) for _ in range(40)))[0] == lang
    assert hits >= 85
    assert langid.Ecoc.loads(m.dumps()).predict("baca da") == m.predict("baca da")


def test_language_on_held_out_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs, langid.train(docs, per_language=200)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    out = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    fold = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"
    a = langid.train(docs, per_language=50)
    b = langid.train(docs.selectExpr("doc_id", f"if({fold}, 'noise', text) as text", f"if({fold}, 'xx', lang) as lang"), per_language=50)
    assert a.languages == b.languages and (a.weights == b.weights).all()


def test_language_sample_with_repeated_and_far_ids(spark):
    ids = spark.range(2000).selectExpr("id", "xxhash64(id) / power(2D, 64) + 0.5 AS s", "crc32(cast(cast(id as string) as binary)) % 4 = 2 AS h")
    ids = [r.id for r in ids.where("not h and s > 0.3").orderBy("id").limit(80).collect()]
    once = [(i, "bacada fagaha " * 5 if i % 2 else "zyxwo vutso " * 5, "aa" if i % 2 else "bb") for i in ids]
    few = [r for r in once if r[2] == "aa"][:4] + [r for r in once if r[2] == "bb"]
    schema = "doc_id long, text string, lang string"
    plain = langid.train(spark.createDataFrame(few, schema), per_language=3)
    assert list(plain.languages) == ["aa", "bb"]
    again = langid.train(spark.createDataFrame(few * 30, schema), per_language=3)
    assert list(again.languages) == ["aa", "bb"] and (again.weights == plain.weights).all()


def test_language_awkward_rows(spark):
    df = awkward(spark, [(60, "123 !! 456"), (61, "ªº x")])
    model = langid.train(df)
    out = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert len(langid.identify(df, model).collect()) == df.count()
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (1, 2, 3, 60))
    assert out[6].lang_pred == "en" and out[None].held_out
    assert all(r.lang_pred == "und" for r in langid.identify(df, None).collect())
    assert langid.identify(empty(spark), model).collect() == []
    assert langid.train(empty(spark)) is None
