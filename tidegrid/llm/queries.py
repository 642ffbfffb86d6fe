"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from tidegrid.catalog.base import Registry
from tidegrid.llm import (
    bpe, classifier, codes, fingerprints, jaccard, licenses, mixing, ppm, rules, sharding, spelling, sql, substrings, warc,
)
from tidegrid.llm.common import residue, settle, table, tokenizer_path

QUERIES = Registry()


@QUERIES.add()
def op1_source_mix(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


@QUERIES.add()
def op2_quality_network(spark, sf_dir):
    held_out = residue("doc_id", 3) == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classifier.score_quality(docs, table(spark, sf_dir, "labels"), train=~held_out)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@QUERIES.add()
def op3_feistel_shards(spark, sf_dir):
    placed = sharding.shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id",
        "placed.size",
        "placed.text_crc32",
        F.lit("rows").alias("law"),
        "placed.shard",
        "placed.slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@QUERIES.add()
def op4_bpe_codec(spark, sf_dir):
    return bpe.encode_decode(
        table(spark, sf_dir, "documents"),
        tokenizer_path(),
        keep=["doc_id"],
        results=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


@QUERIES.add()
def op5_ngram_jaccard_join(spark, sf_dir):
    linked = jaccard.link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return linked.select("doc_id", F.col("group_id").alias("class_id"), "n_links", "n_copies")


@QUERIES.add()
def op6_ratio_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = rules.judge(docs, rules.trusted_ratios(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "rules.*")


@QUERIES.add()
def op9_repeated_passages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substrings.remove_repeats(docs, keep=["doc_id"], with_text=False)
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


@QUERIES.add(
    """
WITH facts AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages),
led AS (
  SELECT *, max(page_id) OVER (PARTITION BY body) AS lead FROM facts)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < lead THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < lead THEN lead END AS refers_to
FROM led"""
)
def op8_warc_archive(spark, sf_dir):
    path = warc.write_archive(table(spark, sf_dir, "pages"), warc.fresh_archive(spark))
    read = warc.read_archive(spark, path)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@QUERIES.add()
def op7_ppm_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = residue("doc_id", 7) == 2
    return ppm.score(docs, ~held_out).withColumn("held_out", held_out).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@QUERIES.add()
def op10_edit_fingerprints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprints.group_prints(settle(fingerprints.compare_with_next(docs), "fingerprints"))


@QUERIES.add(sql.SPELLING)
def op11_spelling_variants(spark, sf_dir):
    return spelling.variant_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@QUERIES.add(sql.CODES)
def op12_vector_codes(spark, sf_dir):
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


@QUERIES.add(sql.licenses_sql())
def op13_license_rules(spark, sf_dir):
    scanned = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return scanned.select("doc_id", *[f"licenses.{c}" for c in names])


@QUERIES.add(corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
