"""A training-data pipeline of five operators over ``documents``.

Stages: language ID (rejected documents go), n-gram Jaccard join (one document of
each group stays), benchmark decontamination (contaminated documents go), mixing to target weights (documents
stay as often as the mix takes them), token files (ids, written and read back).

Each function takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet
to the shared folder and read again as the next one's docs. All but the last return the columns of docs.

Cases (each operator's own are in its docstring): a table without rows goes through all stages; nulls in any
column stay nulls; documents with a null text have no letter and go at the first stage; of rows that repeat
a doc_id the second stage leaves one per group of like texts; columns other than doc_id, text, lang, source are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groupcast.llm.common import cut, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from groupcast.llm.language_id import keep_identified, learn

    return keep_identified(docs, learn(docs, F.lit(True)))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from groupcast.llm.jaccard_tree import keep_one

    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from groupcast.llm.decontaminate import drop_contaminated

    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from groupcast.llm.mixing import mix_documents

    return mix_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from groupcast.llm.queries import tokenizer_path
    from groupcast.llm.token_frames import read_files, write_files

    return read_files(write_files(docs, tokenizer_path()))


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_files", token_files),
]

#: SQL cannot express the trained model, the draw or the files; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
