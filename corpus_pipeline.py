"""A corpus pipeline: quality rules, near duplicates, benchmark decontamination, secrets, mixing.

Every stage but the last takes and returns rows with the columns of documents. Rows travel whole, as one struct beside two hashes of id,
source and text that name them, so null and repeated ids and extra columns of any name do no harm; verdicts find their rows by that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import mixing, secrets
from tidewater.llm.decontamination import decontaminate
from tidewater.llm.jaccard_join import jaccard_components
from tidewater.llm.quality_rules import quality_rules, without_lines
from tidewater.llm.queries import LEVELS, MAX_EPOCHS, WEIGHTS, with_domain
from tidewater.llm.shared import written

_NAME = ["k1", "k2"]


def _named(docs: DataFrame) -> DataFrame:
    """k1, k2 and the row as struct d."""
    parts = ["doc_id", "source", "text"]
    return docs.select(F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *parts).alias("k2"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"))


def _rows(docs: DataFrame, *key: str) -> DataFrame:
    """What operators read, with the row's name (after the columns in ``key``) as column row."""
    parts = [F.col(f"d.{c}").alias(c) for c in key]
    return _named(docs).select(F.struct(*parts, *_NAME).alias("row"), "d.text", "d.source")


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    return _named(docs).join(rejected.select("row.k1", "row.k2").distinct(), _NAME, "left_anti").select("d.*")


def _changed(docs: DataFrame, row: str, clean, changed) -> list:
    """The columns of documents with the text ``clean``; n_chars follows where the text changed."""
    at = lambda c: F.col(f"{row}.`{c}`")
    columns = {c: at(c) for c in docs.columns} | {"text": F.when(changed, clean).otherwise(at("text")), "n_chars": F.when(changed, F.length(clean).cast("long")).otherwise(at("n_chars"))}
    return [columns[c].alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject and cuts lines above their host's limit from the others; n_chars follows where the text changed."""
    found = quality_rules(_rows(docs), "row").where("not kept or size(cut_lines) > 0").select("row.k1", "row.k2", "kept", "cut_lines").dropDuplicates(_NAME)
    out = _named(docs).join(found, _NAME, "left").where("coalesce(kept, true)")
    out = out.withColumn("clean", without_lines(F.col("d.text"), F.col("cut_lines")))
    return out.select(*_changed(docs, "d", F.col("clean"), F.coalesce(F.size("cut_lines"), F.lit(0)) > 0))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the smallest id."""
    found = jaccard_components(_rows(docs, "doc_id"), "row")
    out = _without(docs, found.where("not (row <=> component_id)"))
    # rows equal in id, source and text have one name; one of them stays
    again = written(found.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row.k1", "row.k2"), "pipeline-equal")
    if not again.limit(1).count():
        return out
    out = _named(out)
    once = out.join(again, _NAME, "left_semi").dropDuplicates(_NAME)
    return out.join(again, _NAME, "left_anti").unionByName(once).select("d.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of a benchmark item."""
    found = decontaminate(_rows(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "row")
    return _without(docs, found.where("n_hit > 0"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows where the text changed."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    found = secrets.scan(docs.select(whole.alias("d"), "text"), "d")
    found = found.select(F.struct("d.*", "text").alias("d"), "spans", secrets.redact(F.col("text"), F.col("spans")).alias("clean"))
    return found.select(*_changed(docs, "d", F.col("clean"), F.size("spans") > 0))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chooses documents so that domains, languages and sources follow their weights: id, levels, tokens, copies."""
    return mixing.mix(with_domain(docs), LEVELS, WEIGHTS, F.expr("total * 3 div 5"), max_epochs=MAX_EPOCHS)


STAGES = [("quality_rules", quality), ("jaccard_join", near_duplicates), ("decontamination", decontamination), ("secret_scans", redaction), ("mixing", mixture)]
#: Components of links, spans and digests of five stages are beyond one SQL query; a test holds each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
