"""A corpus from raw documents to token files: STAGES, run one after another, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents. Null texts count as empty throughout, and a stage over an empty table returns an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from gradelake.llm import common, containment, mixing, order_minhash, quality_ledger, queries, token_store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables that earlier stages have written for themselves.
_written: list[str] = []


def _stage(function: Stage) -> Stage:
    """A stage first removes what earlier stages of its run needed, since ``docs`` is written; what ``docs`` still reads stays.

    A run begins with the first stage. What an earlier run has left, its result may still read.
    """

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if function is first_stage:
            _written.clear()
        common.release(_written, docs)
        with common.noted_folders(_written):
            return function(spark, docs, sf_dir)

    return run


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy of the rule ledger."""
    return quality_ledger.filter_documents(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    return order_minhash.one_of_each(docs)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return containment.clean_documents(docs, queries.table(spark, sf_dir, "benchmark"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their share of the source's target asks; repeats are rows of their own."""
    return mixing.mixed_documents(docs)


@_stage
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending order of the id; returns doc_id, start, n_tokens and ids_crc32 as read back."""
    return token_store.digests(token_store.store(docs, queries.tokenizer_path()))


first_stage = quality_rules

STAGES: list[tuple[str, Stage]] = [
    ("quality rules", _stage(quality_rules)),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("source mix", mix_sources),
    ("token files", token_files),
]

#: Order MinHash and a tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
