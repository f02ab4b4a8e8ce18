"""A training corpus from raw documents, in stages that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelith.llm import decontaminate, language, neardup, packing, secrets
from panelith.llm._common import forget_since, free_name, mark, materialise, table

BROADCAST_ROWS = 500_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go."""
    model = language.train(docs.filter(~language.held_out(F.col("doc_id"))))
    into = free_name("_predicted", docs)
    return language.predict(docs, model, into=into).filter(F.col(f"{into}.lang_pred") != language.UNDETERMINED).select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id."""
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go. They go by their text's hash, so null and repeated doc_ids don't matter."""
    key, since, name = F.xxhash64("text"), mark(spark), free_name("_hit", docs)
    hit = decontaminate.contaminated(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(name)).distinct()
    hit = materialise(hit, "contaminated")
    forget_since(since, hit)
    small = hit.count() <= BROADCAST_ROWS  # a number each; beyond that both sides are shuffled
    return docs.join(F.broadcast(hit) if small else hit, key == F.col(name), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    out = secrets.redact(docs, secrets.train(secrets.labelled_samples(spark)))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, each with its sequence and place."""
    return packing.pack(materialise(packing.tokenise(docs), "pieces"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]
#: Trained models, signatures and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
