"""From raw documents to token ids: quality rules, near duplicates, repeated passages, mixing, BPE."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import bpe, jaccard, mixing, rules, substrings
from tidegrid.llm.common import free_name, table, tokenizer_path
from tidegrid.session import clear_scratch, configure, cut_lineage, read_by, scratch_made


# Scratch copies that earlier stages have made for their results.
_LEFT: set[str] = set()


@contextmanager
def _stage(spark: SparkSession, docs: DataFrame) -> Iterator[None]:
    """One stage. A stage's result is stored before the next stage starts, so what earlier
    stages have left goes now, but for what ``docs`` itself still reads."""
    configure(spark)
    spent = _LEFT - read_by(docs, _LEFT)
    clear_scratch(spark, spent)
    _LEFT.difference_update(spent)
    before = scratch_made()
    try:
        yield
    finally:
        _LEFT.update(scratch_made() - before)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and the likelihood ratio; labelled good ones are the target."""
    with _stage(spark, docs):
        out = free_name(docs, "_judged")
        ratios = rules.trusted_ratios(docs, table(spark, sf_dir, "labels"))
        return rules.judge(docs, ratios, out=out).filter(f"{out}.kept").drop(out)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram similarity: the one with the least id."""
    with _stage(spark, docs):
        return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of a smaller id has too; n_chars follows."""
    with _stage(spark, docs):
        cut = substrings.remove_repeats(docs)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    result = cut.withColumn("text", text)
    length = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return result.withColumn("n_chars", length).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole copies."""
    with _stage(spark, docs):
        out = free_name(docs, "_mix")
        mixed = mixing.mix(docs, boundary="whole", out=out)
        return mixing.repeat_taken(mixed, out=out).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of ids and decoded text."""
    with _stage(spark, docs):
        return bpe.encode_decode(
            docs,
            tokenizer_path(),
            keep=["doc_id", "lang", "source", "n_chars"],
            results=("n_tokens", "ids", "ids_sha256", "decoded_sha256"),
        )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

# Likelihood ratios, components and BPE are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again.

    A stored result goes when the next one is stored.
    """
    docs, stored = table(spark, sf_dir, "documents"), frozenset()
    for name, stage in STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        before = scratch_made()
        docs = cut_lineage(result, f"pipeline-{name}")
        clear_scratch(spark, stored)
        stored = scratch_made() - before
    return STAGES[-1][1](spark, docs, sf_dir)
