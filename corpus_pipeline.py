"""A pipeline over ``documents``: each stage reads what the one before kept and wrote.

All stages but the last return the columns of documents; the last returns, for each row of the mix, its place in the
token files and a checksum of its ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reprise.llm import decontamination, mixing, simhash, tokens, toxicity
from reprise.llm.common import table

TOXIC = 0.3
#: The model of toxicity is learned from labels, which SQL can't express; the stages are tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; learned from the labelled ones among those that aren't held out."""
    return toxicity.keep(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")), TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs with a five-word similarity of 0.8 or more connect."""
    return simhash.keep_first(docs, width=5, tau=2, least=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no template window with the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of small sources up to one and a half times."""
    return mixing.mix(docs, mixing.plan(docs, max_repetition=1.5))


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files."""
    path = tokens.new_path(spark, "pipeline-token-ids")
    tokens.write(docs, path)
    return tokens.digests(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_ids", to_token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = tokens.new_path(spark, f"pipeline-{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
