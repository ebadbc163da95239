import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from helpers import awkward, empty

from shopfloor.llm import token_codes as T
from shopfloor.llm.token_codes import (Encoder, Segment, TokenStore, encode_segment, read_documents, read_token, token_output,
                                       write_tokens)

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("top", [1, 200, 49_408, 1 << 24, 1 << 32])
@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_segment_round_trip_and_random_access(top, n):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    ids[::3] %= 200  # some end in the first level
    seg = Segment(encode_segment(ids))
    assert len(seg) == n and (seg.slice(0, n) == ids).all()
    r = random.Random(n)
    for _ in range(40 if n else 0):
        i, j = sorted((r.randrange(n), r.randrange(n + 1)))
        assert seg[i] == ids[i] and (seg.slice(i, j) == ids[i:j]).all()


def test_bad_segment():
    with pytest.raises(ValueError):
        Segment(b"nope" + bytes(20))


def test_encoder_equals_tokenizer(tok):
    enc = Encoder(open(PATH, encoding="utf-8").read())
    r = random.Random(1)
    parts = ["a", "Word", "the", "é", "É", "é", "'s", "'LL", "don't", "1", "23", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "  ",
             "\n", "\t", "　", "!?", ",", "...", "ß", "İ", "日本", "\U0001f600", "</w>", "x" * 90, "́", "\x1c", "ſ", "|", "$$$"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    for text, code in zip(texts, enc(texts)):
        assert np.frombuffer(code, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_capital_sigma_and_every_other_letter(tok):
    enc = Encoder(open(PATH, encoding="utf-8").read())
    texts = ["ΟΔΟΣ", "ΣΑΣ,", "Σ", "ΟΔΟΣ. ΟΔΟς οδοσ ΣΊΣΥΦΟΣ!", "(ΑΣ) ΑΣ's Σ1 aΣ", "ΟΔΟΣ\u0301 ΑΣ\u00adΑ"]
    texts += [f"{a}{chr(c)}{b}" for c in range(0x110000) if chr(c).isalpha() and chr(c).lower() != chr(c)
              for a, b in (("", ""), ("a", ""), ("", "b"), ("Α", "!"))]
    for text, code in zip(texts, enc(texts)):
        assert np.frombuffer(code, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_documents_read_back(spark, tok):
    df = awkward(spark).repartition(5)
    got = token_output(df, PATH, segment_tokens=50).collect()
    data = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    want = []
    for i, t in data:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [i for i, _ in data]


def test_empty_and_reread(spark, tmp_path):
    assert token_output(empty(spark), PATH).collect() == []
    df = spark.createDataFrame([(2, "b"), (1, "a a")], "doc_id long, text string")
    write_tokens(df, str(tmp_path / "t"), PATH)
    assert [(r.doc_id, r.start) for r in read_documents(spark, str(tmp_path / "t")).orderBy("start").collect()] == [(1, 0), (2, 3)]


def test_small_table_turns_over(tok):
    """Two generations of 50 tokens each, many batches: same ids as with a large table."""
    enc = Encoder(open(PATH, encoding="utf-8").read(), table_tokens=50)
    r = random.Random(4)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 9))) + r.choice(["", ",", "!?", "'s"]) for _ in range(600)]
    for _ in range(40):
        texts = [" ".join(r.choices(words, k=20)) for _ in range(5)] + ["", None]
        ids, ends = enc.encode(__import__("pyarrow").array(texts))
        for t, a, b in zip(texts, ends[:-1], ends[1:]):
            assert ids[a:b].tolist() == tok.encode(t or "", add_special_tokens=False).ids
        assert enc.young.n < 50 + 400


def test_every_byte_beside_letters(tok):
    enc = Encoder(open(PATH, encoding="utf-8").read())
    texts = [f"{a}{chr(c)}{b}" for c in range(256) for a in ("", "x", "A1", "é", " ") for b in ("", "y", "'t", "2", "Ü,", "\u0301")]
    for text, code in zip(texts, enc(texts)):
        assert np.frombuffer(code, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("top", [1, 200, 49_408, 1 << 32])
def test_single_tokens_read_few_bytes(top):
    ids = np.random.default_rng(top).integers(0, top, 20_000, dtype=np.uint64).astype(np.uint32)
    data, read_bytes = encode_segment(ids), 0

    def read(at, n):
        nonlocal read_bytes
        read_bytes += n
        return data[at:at + n]
    r = random.Random(top)
    for i in [0, 511, 512, 19_999, *[r.randrange(20_000) for _ in range(300)]]:
        read_bytes = 0
        assert read_token(read, 0, i) == ids[i]
        assert read_bytes < 4 * 90


def test_tokens_are_addressable_in_the_files(spark, tok, tmp_path):
    docs = [(i, " ".join(f"word{(i * 7 + k) % 901} ÜBER" for k in range(i % 90))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    try:
        write_tokens(df, path, PATH, segment_tokens=900)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = [t for _, text in docs for t in [*tok.encode(text, add_special_tokens=False).ids, 2]]
    store = TokenStore(spark, path)
    assert store.segments.count() > 20 and store.segments.select("file").distinct().count() > 1
    r = random.Random(1)
    for position in [0, len(want) - 1, *[r.randrange(len(want)) for _ in range(25)]]:
        assert store.token_at(position) == want[position]
    before = store.bytes_read
    places = [r.randrange(len(want)) for _ in range(10)]
    assert [store.token_at(p) for p in places] == [want[p] for p in places]
    assert store.bytes_read - before < 10 * 360
    with pytest.raises(IndexError):
        store.token_at(len(want))


def test_batches_and_segments_of_any_size(spark, tok, monkeypatch):
    df = awkward(spark).repartition(2)
    want = sorted(str((r.doc_id, r.start, r.n_tokens, r.ids_crc32)) for r in token_output(df, PATH).collect())
    for segment_tokens in (1, 7, 10**9):
        got = token_output(df, PATH, segment_tokens=segment_tokens)
        assert sorted(str((r.doc_id, r.start, r.n_tokens, r.ids_crc32)) for r in got.collect()) == want
    import pyarrow as pa
    texts = pa.array(["a" * 10, None, "b" * 3, "", "c" * 99])
    monkeypatch.setattr(T, "BATCH_BYTES", 12)
    assert list(T._slices(texts)) == [(0, 2), (2, 4), (4, 5)]


def test_read_texts_are_let_go(monkeypatch):
    """Ids and texts of a record batch share one buffer: an open segment must not hold it."""
    import weakref

    import pyarrow as pa
    from pyspark import TaskContext

    class Task:
        def partitionId(self):
            return 0
    monkeypatch.setattr(TaskContext, "get", staticmethod(Task))
    alive, most = [], 0

    def batches():
        nonlocal most
        for k in range(12):
            made = pa.record_batch([pa.array([2 * k, None], pa.int64()), pa.array(["a b " * 2000, f"c{k}"])], names=["id", "t"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, made.schema) as out:
                out.write_batch(made)
            body = np.frombuffer(sink.getvalue(), np.uint8).copy()
            alive.append(weakref.ref(body))
            most = max(most, sum(x() is not None for x in alive))
            yield pa.ipc.open_stream(pa.py_buffer(body)).read_next_batch()
            del body

    class Json:
        value = open(PATH, encoding="utf-8").read()
    rows = list(T._write_segments(Json, 10**9, 2)(batches()))
    assert len(rows) == 1 and rows[0].column(4)[0].as_py() == [x for k in range(12) for x in (2 * k, None)]
    assert most <= 3


def test_workers_get_a_few_megabytes_at_a_time(spark, tmp_path, monkeypatch):
    """Long texts come in record batches of about INPUT_BYTES; the session keeps its own setting."""
    import pyarrow as pa

    from shopfloor.session import INPUT_BYTES

    def sizes(*_):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([v], t) for v, t in zip((0, 0, 0, b.nbytes), T.SEGMENT_SCHEMA.types)],
                     *[pa.array([[0]], pa.list_(pa.int64()))] * 2, pa.array([b""])], schema=T.SEGMENT_SCHEMA)
        return run
    monkeypatch.setattr(T, "_write_segments", sizes)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    df = spark.range(60).selectExpr("id AS doc_id", "repeat('some words ', 30000) AS text").coalesce(1)
    for own in (None, "12345678"):
        spark.conf.unset(key) if own is None else spark.conf.set(key, own)
        write_tokens(df, str(tmp_path / f"t{own}"), PATH)
        assert spark.conf.get(key, None) == own
        got = [r.n_tokens for r in spark.read.parquet(str(tmp_path / f"t{own}")).collect()]
        assert sum(got) > 60 * 330_000 and max(got) < 2 * INPUT_BYTES
    spark.conf.unset(key)
