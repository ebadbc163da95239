"""Small tables with awkward rows, shared by the corpus operator tests."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


#: (doc_id, text, lang, source, n_chars, words, row, id): the last three clash with names used inside operators.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ws string, row long, id string"


def awkward(spark, more=()):
    long_text = " ".join(f"w{i % 997}" for i in range(60_000))
    texts = [(1, None), (2, ""), (3, "   \t\n "), (4, "one"), (5, "two words"), (6, "Same text here"), (7, "Same text here"),
             (7, "Same text here"), (None, "no id at all"), (None, None), (8, long_text), (9, prose(1, 60)),
             (10, prose(1, 60)), (11, prose(2, 40)), (12, "Ünïcödé ÄÖÜ 日本語 \U0001f600 ok"), *more]
    rows = [(i, t, "en" if k % 3 else None, None if k % 5 == 0 else f"s{k % 3}", 0, "x", 7, "y")
            for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *cols):
    """The rows as a sorted list of tuples, nulls first."""
    got = [tuple(r) for r in df.select(*cols).collect()]
    return sorted(got, key=lambda r: tuple((v is not None, v) for v in r))
