"""Corpus pipeline: five stages, each applying one operator to all that the one before kept.

1. language: documents that operator 3 (``language_mixture.predict``) calls ``und`` go: those
   without a letter, and all if nothing was learned. It rejects no others, however unlikely.
2. exact_dedup: of equal texts one stays (the digest index).
3. near_dedup: of each component of texts with similar five-word shingles (Jaccard 0.8 or more)
   the document with the smallest id stays. Rows go by id and text, so that other texts of the
   same id, or without an id, stay.
4. pii: personal data in texts is replaced by its kind.
5. packing: token ids are packed into training windows.

Every stage is written as Parquet to the shared scratch folder and read again. All stages but
the last return the columns of ``documents``, others included. Rows with a null ``doc_id`` stay
unless their text is a copy, or similar to a document that has an id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from litrank.llm import language_mixture, pii_crf
from litrank.llm.digest_index import DigestIndex, keep_first_copies
from litrank.llm.ngram_join import ngram_jaccard_join, text_hash
from litrank.llm.packing import pack_documents
from litrank.llm.stages import stored
from litrank.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"

# SQL has no tokenizer, no language model and no random field; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def language(spark, docs, sf_dir):
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2
    model = language_mixture.fit(docs.where(learn).select("text", "lang"))
    return language_mixture.identified(docs, model)


def exact_dedup(spark, docs, sf_dir):
    marks = stored(DigestIndex(spark).add(docs), "marks")
    return keep_first_copies(docs, marks)


def near_dedup(spark, docs, sf_dir):
    marks = ngram_jaccard_join(docs, n=5, percent=80)
    marks = stored(marks.select("doc_id", "component_id", "text_hash"), "near-marks")
    gone = marks.where("NOT (doc_id <=> component_id)") \
        .select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("gone_id")) & (text_hash("text") == F.col("gone_hash"))
    return docs.join(gone, same, "left_anti")


def pii(spark, docs, sf_dir):
    clean = pii_crf.redact(docs, pii_crf.fit(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def packing(spark, docs, sf_dir):
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("pii", pii), ("packing", packing)]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
