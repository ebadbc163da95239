import re

import corpus_pipeline as P
import public_tokenizers
from helpers import awkward, empty, prose

from shopfloor.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r for r in docs.collect()}
    kept, at = docs, {}
    for name, stage in P.STAGES[:-1]:
        kept = materialize(stage(spark, kept, SF), f"test-{name}")
        assert kept.columns == docs.columns
        at[name] = [r.doc_id for r in kept.collect()]
        for r in kept.collect():
            assert r == text[r.doc_id]  # rows are passed on unchanged
    for name in ("quality", "near_dedup", "decontaminate"):
        assert len(set(at[name])) == len(at[name])
    assert set(at["mix"]) <= set(at["decontaminate"]) <= set(at["near_dedup"]) <= set(at["quality"])
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(i in set(at["quality"]) for i in clean) >= 0.95 * len(clean)
    assert not any(labels[i].quality == 0 for i in at["quality"] if i in labels)
    last = P.STAGES[-1][1](spark, kept, SF).collect()
    assert sorted(r.doc_id for r in last) == sorted(at["mix"])
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in last[:20]:
        assert r.n_tokens == len(tok.encode(text[r.doc_id].text, add_special_tokens=False).ids) + 1


def test_awkward_rows_pass_every_stage(spark):
    near = prose(9, 300)
    df = awkward(spark, [(70, near), (71, near), (71, near)])
    for name, stage in P.STAGES:
        out = materialize(stage(spark, df, SF), f"test-{name}")
        if name != "tokens":
            assert out.columns == df.columns
        if name == "near_dedup":
            got = [r.doc_id for r in out.collect()]
            assert 70 in got and 71 not in got and got.count(7) == 0 and got.count(6) == 1
        if name == "decontaminate":
            assert out.count() == df.count()
        if name == "tokens":
            assert out.count() == df.count()
        assert stage(spark, empty(spark), SF).count() == 0


def test_names_and_contract():
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    assert not re.search("localCheckpoint", open(P.__file__).read())
