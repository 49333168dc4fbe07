"""The corpus pipeline: toxicity, exact dedup, near dedup, secret masking, packing; each stage's output is stored.

Every stage but the last returns the columns of documents. Toxicity drops documents that score its threshold or more;
exact dedup keeps the row with the smallest doc_id of equal texts; the n-gram Jaccard join keeps the smallest doc_id
of each component; the secret scan keeps every document and masks the secrets in its text; packing returns the pieces
and their places. n_chars of a masked text is its new length. Other columns than the ones that a stage reads go through
it under names of the pipeline's own, so that none can clash with a name inside an operator.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import exact_dedup, jaccard, packing, secrets, toxicity
from kgspark.llm.common import checkpoint, stored, table

#: No SQL: the toxicity model, the components and the packing can't be stated in it; tests compare with brute force.
ORACLE_SQL = None


#: The columns that stages read or write; all others only pass through.
READ = ("doc_id", "text", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def apart(stage: Stage) -> Stage:
    """A stage that keeps all columns, run with its other columns renamed, and given back under their names."""

    @wraps(stage)
    def run_apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        renamed = docs.toDF(*[c if c in READ else f"__passed_{i}" for i, c in enumerate(docs.columns)])
        return stage(spark, renamed, sf_dir).toDF(*docs.columns)

    return run_apart


@apart
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


@apart
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_rows(docs).select(*docs.columns)


@apart
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = jaccard.marked_components(docs)
    dropped = checkpoint(classes.where("not doc_id <=> component_id").select("doc_id", "mark").distinct())
    same = F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (jaccard.mark("d.text") == F.col("x.mark"))
    return docs.alias("d").join(dropped.alias("x"), same, "left_anti").select(*docs.columns)


@apart
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redacted(secrets.scan(docs).withColumn("__found", F.size("spans") > 0))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("__found"), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
