"""The corpus pipeline: five operators of ``shopfloor.llm`` over ``documents``, one after another.

Each stage is written as Parquet and read again before the next; all but the last
return the columns of ``documents`` (rows dropped, or repeated by the mix).

1. quality         documents whose probability of the best grade is too low go
2. near_dedup      one document of each SimHash component stays: the smallest id
3. decontaminate   documents with enough words inside benchmark windows go
4. mix             every document is repeated as often as the mix takes it
5. tokens          token files of what is left; one row per document read back from them

Defined results: rows that repeat an id with the same text are one document to near_dedup (one
row stays); a null id never outranks another. Null texts and empty tables pass through as
the operators define. Extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shopfloor.llm import decontaminate as decon
from shopfloor.llm import mixing, quality, simhash, token_codes
from shopfloor.session import materialize

ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the rated documents of the whole table, applied to the rows given."""
    model = quality.train(_table(spark, sf_dir, "documents"), quality.label_grades(_table(spark, sf_dir, "labels")))
    return quality.select_quality(docs, model)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decon.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_to_mix(docs)


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_codes.token_output(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", stage_quality), ("near_dedup", stage_near_dedup), ("decontaminate", stage_decontaminate),
          ("mix", stage_mix), ("tokens", stage_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
