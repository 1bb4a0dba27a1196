"""A training corpus from raw documents: five stages, each stored and read again.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of
documents. A stage works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import decontaminate, jaccard, langid, lines, packing
from termloom.session import written

#: Mean posterior below which a text has no language; the mean of several is lower.
MIN_SCORE = 0.5
#: Near copies share so many per cent of their five-word shingles.
SHINGLE, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are mostly in one of the languages learned from those not held out."""
    model = langid.train(docs.where(~langid.held_out()).where("doc_id is not null").select("doc_id", "text", "lang"))
    found = langid.identified(docs, model)
    return found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_SCORE)).select("own.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of runs of lines; those with nothing left go."""
    out = lines.dedup_lines(docs, drop_emptied=True)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard links."""
    return jaccard.one_of_each(docs, shingle=SHINGLE, percent=PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_contamination(docs, items, window=10, carry=True).where("n_hit = 0").select("own.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, as sequences of 2048 tokens."""
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packed),
]

#: Learned models and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
