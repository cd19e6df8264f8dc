"""A corpus pipeline of five stages: language ID, SimHash near-dedup, secret scan, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and all but the last return the columns of ``docs``; extra columns are carried
along, whatever their names. An empty table stays empty through all stages.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.byte_bpe import recode_bpe
from weftline.llm.common import drop_at_exit, drop_folder, ensure_checkpoint_dir
from weftline.llm.language import fit_languages, held_out, predict_languages
from weftline.llm.mixing import mix_sources, repeat_copies, word_count
from weftline.llm.queries import BPE_VOCAB
from weftline.llm.secrets import redact_secrets
from weftline.llm.simhash import SIMILARITY, keep_one_of_each_group


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that clash with no operator's columns, and the new name of each old one."""
    names = {c: f"doc_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, with it in ``lang``; those rejected, and texts without a letter, go."""
    plain, n = _renamed(docs)
    model = fit_languages(plain.where(~held_out(n["doc_id"], 5, 0)), n["doc_id"], n["text"], n["lang"])
    told = predict_languages(plain, model, n["text"]).where("not rejected")
    return told.withColumn(n["lang"], F.col("lang_pred")).select(*[F.col(new).alias(old) for old, new in n.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by fingerprint or by five-word shingles."""
    plain, n = _renamed(docs)
    kept = keep_one_of_each_group(plain, n["doc_id"], n["text"], SIMILARITY)
    return kept.select(*[F.col(new).alias(old) for old, new in n.items()])


def scrub_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced and ``n_chars``, where there is such a column, counted anew."""
    plain, n = _renamed(docs)
    clean = redact_secrets(plain, n["text"])
    if "n_chars" in n:
        length = F.char_length(n["text"]).cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn(n["n_chars"], F.coalesce(length, F.col(n["n_chars"])))
    return clean.select(*[F.col(new).alias(old) for old, new in n.items()])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each copy."""
    plain, n = _renamed(docs)
    mixed = mix_sources(plain.withColumn("size", word_count(n["text"])), n["doc_id"], n["source"])
    return repeat_copies(mixed, [F.col(new).alias(old) for old, new in n.items()])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids, their number, and whether they decode to the text's bytes."""
    path = os.environ.get("WEFTLINE_BPE_VOCAB") or public_tokenizers.path(BPE_VOCAB)
    slim = docs.select("doc_id", "lang", "source", "text")
    both = recode_bpe(slim, path, public_tokenizers.PATTERN)
    whole = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("decodes"))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("secrets", scrub_secrets),
    ("mixing", mix),
    ("byte_bpe", tokenize),
]

#: Language ID, secrets and BPE can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what lies between them is Parquet in the shared folder.

    A stage's rows are removed when the next one's are written, the last ones when the application ends.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    drop_at_exit(spark, folder)
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            drop_folder(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
