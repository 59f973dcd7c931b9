"""Registered queries: each applies one operator to its whole table and derives the digest
columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, decontamination, html_extract, jaccard_join, language_id, line_dedup, packing, pii, prefix_trie,
               ranked_search, sharding, token_counts, warc)
from .common import read_table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=2048, end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                      "sequence_id", "offset")


def _stand_in_edits(docs: DataFrame) -> DataFrame:
    """Three edits a document: places, lengths and replacements (parts of the text) by hash."""
    n = F.char_length("text")

    def edit(i: int):
        def draw(k: int, below):
            return F.pmod(F.xxhash64("doc_id", F.lit(i), F.lit(k)), below.cast("long")).cast("int")
        return F.struct(F.lit(i).alias("seq"), draw(0, n + 1).alias("start"), draw(1, F.lit(40)).alias("length"),
                        F.substring("text", draw(2, n + 1) + 1, draw(3, F.lit(60))).alias("replacement"))

    return docs.where(n > 0).select("doc_id", F.inline(F.array(*[edit(i) for i in range(3)])))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    trees = token_counts.build_trees(docs, tokenizer)
    out = token_counts.apply_edits(docs, trees, _stand_in_edits(docs), tokenizer)
    return out.select("doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited", "chars_reencoded")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    items = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    out = decontamination.decontaminate(docs, items, n=13, share=20)
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the pages have no capture time; their ids stand in for a clock
    clock = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod("page_id", F.lit(10**8)))
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html", clock.alias("captured"))
    out = warc.archive_and_index(pages, min_bytes=0)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shard(docs, n_shards=16)
    text = F.coalesce("record.text", F.lit(""))
    return out.select(F.col("record.doc_id").alias("doc_id"),
                      (F.octet_length(text) + 1).cast("long").alias("size"),
                      F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
                      "shard", F.col("slot").cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = jaccard_join.jaccard_classes(docs, n=5, threshold=0.8)
    return out.select("doc_id", "class_id", "n_links", "n_copies", "n_texts")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.is_held_out(F.col("doc_id"))
    model = language_id.train(docs.where(~held_out).select("text", "lang"))
    out = language_id.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.find(docs, pii.train(docs))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                      F.sha2("base", 256).alias("base_sha256"), "spans",
                      F.size(F.filter(F.split("spans", ","), lambda s: s != "")).cast("long").alias("n_spans"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = html_extract.extract(pages, html_extract.train(pages))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    items = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    return ranked_search.search(docs, items, k=20)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turn_rows(read_table(spark, sf_dir, "conversations"))
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(4))
    begin = prefix_trie.leads(turns, F.col("conv_id") - F.col("conv_id") % 20, taken, most=3)
    return prefix_trie.trie(turns, begin).drop("key", "words")


QUERIES = (op1_line_dedup, op2_packing, op3_token_counts, op4_nearest_neighbours, op5_decontamination, op6_warc,
           op7_sharding, op8_jaccard_join, op9_language_id, op10_pii, op11_html_extraction, op12_ranked_search,
           op13_prefix_trie)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}
