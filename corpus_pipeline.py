"""The corpus pipeline: documents to token ids, in stages that each call one training-data operator.

STAGES: (name, function); a function takes (spark, docs, sf_dir) and gives a DataFrame, written as Parquet in the
shared folder and read again as the next one's docs; a stage's folder is removed once the next one's is written. The last stage has written
its rows as ORC itself, so `run` gives the DataFrame that reads them. The toxicity lexicon is fitted on the documents and labels given.

Defined results, by stage, for what is awkward (each operator's docstring has more):
toxicity: rows without a text, or with an empty one, aren't toxic and stay, as do repeated rows and rows without an id; very long texts are read whole, their score is by length.
simhash_near_dedup: rows without a word are no copies and stay; of rows with near texts one stays, whatever their ids, also of repeated rows and rows without an id.
benchmark_decontamination: rows without a text stay; a row goes by its own text, of any length, whatever its id.
source_mixing: rows without a text or id stay; a null source is a source; texts that reach over the end of a block come in pieces, with the row's other columns on each.
token_orc: a null text has null tokens, an empty one none; repeated rows and ids and null ids are kept.
Every stage gives an empty table for an empty one, and keeps further columns, whatever their names, but for the last, which gives doc_id, n_tokens, tokens and position.
Ties: a document whose labels differ counts as toxic in fitting; of near copies the smallest doc_id stays; equal ids in a block are ordered by a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skriva.llm import decontaminate, mixing, simhash, token_output, toxicity
from skriva.llm.common import load, shared_path
from skriva.session import remove_shared


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed order stays as the column `position`, by which a reader of the tokens sorts."""
    return token_output.write_tokens(docs, shared_path(spark, "pipeline-tokens"), position=token_output.file_position(docs))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mixed),
    ("token_orc", token_ids),
]

#: SQL can't express the fitted lexicon, the fingerprints or the byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove_shared(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
