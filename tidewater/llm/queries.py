"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, mixing, oracles, quality_classifier, secrets, toxicity
from .decontamination import decontaminate
from .jaccard_join import jaccard_components
from .quality_rules import quality_rules
from .shared import fold, written
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held(id_col: str, parts: int, part: int) -> Column:
    """Whether a row is held out; one of null id is neither held out nor learned from."""
    return F.coalesce(fold(id_col, parts) == part, F.lit(False)).alias("held_out")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = written(quality_classifier.document_statistics(_table(spark, sf_dir, "documents")), "quality-features")
    forest = quality_classifier.train(features, _table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    scores = quality_classifier.score(features, forest)
    return scores.select("doc_id", _held("doc_id", 3, 1), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), size=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


#: The budget tree: a domain is the source's number modulo 4, sources without a number are a domain of their own.
LEVELS = ["domain", "lang", "source"]
WEIGHTS = {"domain": {"d0": 40, "d1": 30, "d2": 20, "d3": 10}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}
MAX_EPOCHS = 4


def with_domain(docs: DataFrame) -> DataFrame:
    return docs.withColumn("domain", F.expr("coalesce(concat('d', cast(try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') as bigint) % 4 as string)), 'other')"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(with_domain(_table(spark, sf_dir, "documents")), LEVELS, WEIGHTS, F.expr("total * 3 div 5"), max_epochs=MAX_EPOCHS)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    kinds = F.transform("spans", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.joined_spans(base), 256).alias("base_sha256"), secrets.joined_spans(F.col("spans")).alias("spans"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_line_words", "kept")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    counts = language_id.gram_counts(docs.where(fold("doc_id", 4) != 2))
    found = language_id.identify(docs, counts)
    return found.select("doc_id", _held("doc_id", 4, 2), "lang_pred", "score")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    scores = toxicity.score(docs, model)
    return scores.select("doc_id", _held("doc_id", 3, 1), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_jaccard_join, op3_suffix_dedup, op4_mix_sources, op5_decontaminate, op6_secret_scan, op7_quality_rules, op8_language_id, op9_substring_dedup, op10_toxicity)}

_DOMAIN_SQL = "coalesce('d' || (TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT) % 4)::VARCHAR, 'other')"
ORACLES: dict[str, str] = {
    "op4_mix_sources": mixing.mix_sql(f"SELECT doc_id, {_DOMAIN_SQL} AS domain, lang, source, text FROM documents", LEVELS, WEIGHTS, "total * 3 // 5", max_epochs=MAX_EPOCHS),
    "op2_jaccard_join": oracles.JACCARD,
    "op5_decontaminate": oracles.DECONTAMINATION,
    "op7_quality_rules": oracles.QUALITY_RULES,
    "op9_substring_dedup": oracles.SUBSTRING,
}
