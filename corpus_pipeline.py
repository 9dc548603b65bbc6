"""From raw documents to token ids in training order.

Each stage gets what the one before it kept, as reread from Parquet. Documents without text in a known language go;
then exact copies (the largest doc_id stays); then near-duplicates by SimHash (the smallest doc_id of each group
stays); what is left is ordered so that sources meet their target weights at every point, and encoded. The mixing
stage's decision is an order: its rows come sorted by slot, and the last stage names the slot beside the ids, since
readers of Parquet don't keep an order.

Defined results: a null text, or one without letters, goes at the first stage; rows without an id, and rows that share
one, are documents of their own all the way, as long as their texts differ: each row that a stage keeps is one row of
the next, nothing is joined by id; equal rows are copies, of which one stays; of equal texts a row without an id stays
only where no row has one; an empty table, or one without labelled languages, gives an empty result. Other columns are
carried up to the last stage, whatever their names. run() leaves the last stage's files, which its result reads, in the
shared folder and deletes those of the stages before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, langid, mixing, simhash
from tidemark.llm.common import delete, importable, shared_folder, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_languages(docs, langid.fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, slot of the mix, n_tokens, ids."""
    placed = mixing.mix_rows(docs).select("row.doc_id", F.col("row.source").cast("string").alias("source"), "slot", "row.text")
    return bpe.encode(placed, keep=("source", "slot")).select("doc_id", "source", "slot", F.size("ids").cast("long").alias("n_tokens"), "ids")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _on_workers(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        importable(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("language_id", _on_workers(language_id)),
    ("exact_dedup", _on_workers(exact)),
    ("simhash_dedup", _on_workers(near)),
    ("mix_sources", _on_workers(mix)),
    ("bpe", _on_workers(tokens)),
]

#: SQL has no kernels, XXH64 or BPE; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            delete(spark, before)
        before = f"{folder}/{name}"
    return docs
