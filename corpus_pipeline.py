"""Raw documents to packed training sequences, in five stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written and read back as the next one's ``docs``. All stages but the last
return the columns of ``docs``; columns the stages do not know travel along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm import decontamination, jaccard_join, language_id, line_dedup, packing
from skyframe.llm.common import materialise, read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language the labels teach (no text, no letter)."""
    model = language_id.train(docs.where(~language_id.is_held_out(F.col("doc_id"))).select("text", "lang"))
    plain = docs.withColumnsRenamed({c: f"__{c}" for c in ("lang_pred", "score") if c in docs.columns})
    kept = language_id.predict(plain, model).where(F.col("lang_pred") != "und")
    return kept.select(*[(f"__{c}" if c in ("lang_pred", "score") else c) for c in docs.columns]).toDF(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines repeated in five documents or more but for one; ``n_chars`` follows."""
    added = {"kept_text", "n_lines", "n_dropped"}
    plain = docs.withColumnsRenamed({c: f"__{c}" for c in added & set(docs.columns)})
    out = line_dedup.dedup_lines(plain, min_chars=40, min_docs=5)
    new = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast(
        docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[(new.get(c) if new.get(c) is not None else F.col(f"__{c}" if c in added else c)).alias(c)
                        for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by five-word shingles at 0.8 or more."""
    return jaccard_join.keep_one(docs, n=5, threshold=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more lies in windows of 13 benchmark words."""
    items = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = decontamination.decontaminate(docs, items, n=13, share=20).where("contaminated")
    bad = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens, with their ids (little-endian unsigned 32-bit)."""
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=2048, end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                      "sequence_id", "offset", "ids")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Language identification and tokenization have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
