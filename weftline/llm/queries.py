"""The registered queries over the synthetic tables, and the SQL that some of them are held against."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import alignment_report
from .byte_bpe import recode_bpe
from .chat import DIGEST_SQL, conversation_digests, expand_replies
from .common import cut
from .embeddings import near_duplicate_vectors
from .katz import score_texts
from .language import fit_languages, held_out, predict_languages
from .mixing import MIX_SQL, mix_sources, word_count
from .quality import quality_rules
from .quantiles import quantile_report, shop_streams
from .secrets import BASE_KINDS, find_secrets, listed
from .simhash import near_duplicate_groups
from .toxicity import fit_toxicity, score_toxicity
from .url_filter import FETCHED, URL_SQL, filter_urls, page_entries

#: Score from which a document counts as toxic.
TOXIC = 0.3
BPE_VOCAB = "byte_bpe_multi_50k.tiktoken"
ALIGNED_VOCABS = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", *map(count, BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans")
    )


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.expr(FETCHED).alias("fetched"))
    told = F.array_join(F.transform("active", lambda x: F.concat_ws("|", x["list"], x["value"], x["since"].cast("string"))), ",")
    return filter_urls(pages, page_entries(pages)).select(
        "page_id", F.col("fetched").cast("string").alias("fetched"), F.size("active").cast("long").alias("n_active"), "blocked", told.alias("active"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"))
    return mix_sources(cut(docs)).select("doc_id", "size", "source_size", "target", "taken")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversation_digests(expand_replies(stored.union(added)))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = os.environ.get("WEFTLINE_BPE_VOCAB") or public_tokenizers.path(BPE_VOCAB)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return recode_bpe(docs, path, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out("doc_id", 5, 0)
    model = fit_languages(docs.where(~held))
    return predict_languages(docs.select("doc_id", "text", held.alias("held_out")), model).drop("text")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, _table(spark, sf_dir, "labels")).drop("text")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out("doc_id", 4, 2)
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels").where(~held))
    scored = score_toxicity(docs.select("doc_id", "text", held.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op11_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = (_table(spark, sf_dir, name) for name in ("clicks", "sale_lines", "items"))
    found = quantile_report(shop_streams(*tables, batches=8), parts=10, least=20)
    within = (1000 * F.col("rank_error") <= 50 * F.col("n")).alias("within")
    return found.select("stream", "grp", "batch", "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", within)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = map(public_tokenizers.path, ALIGNED_VOCABS)
    return alignment_report(_table(spark, sf_dir, "documents").select("doc_id", "text"), a, b)


def op13_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, ~held_out("doc_id", 5, 1))
    return scored.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_secrets": op2_secrets,
    "op3_urls": op3_urls,
    "op4_mixing": op4_mixing,
    "op5_chat": op5_chat,
    "op6_embeddings": op6_embeddings,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_language": op8_language,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_quantiles": op11_quantiles,
    "op12_alignment": op12_alignment,
    "op13_katz": op13_katz,
}

ORACLES: dict[str, str] = {
    "op3_urls": URL_SQL,
    "op4_mixing": MIX_SQL,
    "op5_chat": DIGEST_SQL,
}
