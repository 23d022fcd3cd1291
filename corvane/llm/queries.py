"""The queries of this subpackage over a folder of tables, and their SQL where SQL can say them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import alignment, chat_format, decontaminate, language_id, near_dedup, packing, quality, resample, substring_dedup, suffix_dedup, topk_search, toxicity, url_filter
from corvane.llm.shared import cut, held_out, table

VOCABULARY = "word_bpe_49k.json"
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(topk_search.usable(F.col("embedding")))
    whole = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(64 * x.cast("double"))).alias("vector"))
    return topk_search.search(whole.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), whole, 20)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = chat_format.read_back(chat_format.format_trees(chat_format.linear_trees(rows)))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))))
    return out.select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = language_id.learn(docs.where(~held_out(F.col("doc_id"))))
    out = language_id.classify(docs.select("doc_id", "text"), dictionaries)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.find_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.find_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    out = toxicity.score(docs.select("doc_id", "text"), grammar)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    digest = F.pandas_udf(lambda items: pd.Series([decontaminate.items_digest(x) for x in items]), "string")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    rows = cut(quality.with_statistics(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "statistics"), "quality")
    ensemble = quality.learn(rows, table(spark, sf_dir, "labels").where(rest() != 0))
    return quality.score(rows, ensemble).select("doc_id", F.coalesce(rest() == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_exact_topk, op3_chat_format, op4_language_id, op5_substring_dedup, op6_url_filter, op7_best_fit_packing, op8_suffix_dedup, op9_toxicity, op10_decontaminate, op11_quality_rules, op12_cross_tokenizer_alignment, op13_importance_resampling)}
