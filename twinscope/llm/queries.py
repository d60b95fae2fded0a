"""The operators over their whole tables, with production parameters, and their check SQL."""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinscope.llm import decontamination, jaccard, language, lexical, mixing, multiindex, quality, secrets, suffixes, tokens, topk, toxicity, whitening
from twinscope.llm.labelled import held_out
from twinscope.plans.scratch import scratch_root


def tokenizer_path() -> str:
    """The vocabulary file; another folder of public tokenizers may be named by TOKENIZER_DIR."""
    folder = os.environ.get("TOKENIZER_DIR")
    return os.path.join(folder, "word_bpe_49k.json") if folder else public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _judged(scores: DataFrame, out: F.Column) -> DataFrame:
    return scores.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _judged(quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels"))), held_out(3, 1))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(_table(spark, sf_dir, "documents"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read(*tokens.write(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integers(_table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _judged(toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels"))), held_out(5, 0))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table as two commits to a new ledger: blobs of the first aren't scanned again for the second."""
    docs = _table(spark, sf_dir, "documents")
    ledger = secrets.Ledger(spark, f"{scratch_root(spark).rstrip('/')}/secrets-{uuid.uuid4().hex}")
    first = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(True))
    ledger.commit(docs.where(first), "1")
    ledger.commit(docs.where(~first), "2")
    return ledger.findings(docs.schema["doc_id"].dataType.simpleString())


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learning = F.col("doc_id").isNotNull() & ~held_out(3, 1)
    return language.predict(docs, *language.fit(docs, learning)).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return multiindex.Index(vectors).search(vectors.where(F.col("vec_id") % 50 == 0))


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_suffix_dedup, op3_tokens, op4_topk, op5_mixing, op6_toxicity, op7_decontamination, op8_secrets, op9_language, op10_ngram_join,
    op11_lexical, op12_whitening, op13_neighbours)}
SQL = {"op4_topk": topk.SQL, "op11_lexical": lexical.SQL}
