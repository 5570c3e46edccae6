"""The corpus pipeline: documents to token files in five stages, each calling one operator.

Quality classifier (rejected documents go), n-gram Jaccard join (one document of each group stays), benchmark
decontamination (documents that hold an item go), mixing sources to target weights (documents are taken not at all, once
or twice, in the order of their virtual finish times), token output in that order (one row per document and time taken).

A stage is called with the session, the documents its predecessor kept, and the folder of the tables. SQL can't express
the classifier or the tokenizer, so there is no ORACLE_SQL; ``test_pipeline_is_brute_force`` holds each stage against a
plain version of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm import decontam, jaccard, mixing, quality, tokens
from fabula.llm.common import documents, materialize, release, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    labels = quality.learning_labels(spark, sf_dir)
    labelled = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    model = quality.fit(quality.document_statistics(labelled), labels)
    return quality.good_documents(docs, model)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sized = mixing.sized(docs.select(*COLUMNS))
    small = materialize(sized.select("doc_id", "source", "size", "mix_key"), "mix-sizes")
    return mixing.mixed_stream(mixing.weighted_fair_mix(sized, small, whole=True)).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix is read from Parquet, whose partitions by number, files in them and rows in those are in the order in which it
    was served; names alone are not, since part-100000 sorts before part-99999."""
    name = F.col("_metadata.file_name")
    part = F.regexp_extract(name, r"part-(\d+)", 1).cast("int")
    served = docs.select("doc_id", "text", part.alias("mix_part"), name.alias("mix_file"), F.col("_metadata.row_index").alias("mix_row"))
    return tokens.token_output(served, order=("mix_part", "mix_file", "mix_row"))


STAGES = [
    ("quality", quality_stage),
    ("jaccard", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; what a stage keeps is written and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
