"""Token totals by source, language and tokenizer version, maintained by deltas.

A batch of changes is turned into signed counts: rows of its documents are added, and what the committed batches hold
of these documents is taken away. Signed counts are summed to a delta; totals are sums of deltas. A batch writes its
signed counts, then its delta, each to a folder of its own name (written anew if an earlier try broke off), and last
its commit. Only committed batches are read, and a committed batch is not applied again.

Rules for input: null text is empty; an upsert replaces all rows of its ids by all the batch's rows of those ids, so
repeated rows each count; a delete takes all rows of its ids; null ids are one id; null sources and languages are
groups of their own; other columns are ignored; an empty batch commits an empty delta.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Counters by tokenizer version; any column function of the text, a Pandas UDF of a vocabulary too, can be one.
VERSIONS: dict[str, Callable[[Column], Column]] = {
    "words-v1": lambda text: F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")),
    "words-v2": lambda text: F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]")),
}
GROUP = ["source", "lang", "tokenizer"]
SIGNED = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long, chars long"


def counted(docs: DataFrame, versions: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row for each document and tokenizer version."""
    text = F.coalesce("text", F.lit(""))
    each = F.array(*[F.struct(F.lit(name).alias("tokenizer"), count(text).cast("long").alias("tokens")) for name, count in versions.items()])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.length(text).cast("long").alias("chars"), F.explode(each).alias("n"))
    return rows.select("doc_id", "source", "lang", "n.tokenizer", F.lit(1).cast("long").alias("docs"), "n.tokens", "chars")


class Ledger:
    """The batches under one folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, batch string").parquet(f"{self.path}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{schema}, batch string")

    def commits(self) -> DataFrame:
        return self._read("commits", "applied boolean").select("batch").distinct()

    def _committed(self, name: str, schema: str) -> DataFrame:
        return self._read(name, schema).join(self.commits(), "batch", "left_semi").drop("batch")

    def apply(self, batch: str, docs: DataFrame, versions: dict[str, Callable[[Column], Column]] | None = None, delete: bool = False) -> bool:
        """Applies a batch of upserts of docs (doc_id, source, lang, text), or deletes of their ids; False if it was before."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch is named by letters, digits, - and _")
        if self.commits().where(F.col("batch") == batch).count():
            return False
        ids = docs.select(F.col("doc_id").cast("long").alias("id")).distinct()
        old = self._committed("signed", SIGNED).join(ids, F.expr("doc_id <=> id"), "left_semi")
        old = old.select("doc_id", *GROUP, *[(-F.col(c)).alias(c) for c in ("docs", "tokens", "chars")])
        signed = old if delete else old.unionByName(counted(docs, VERSIONS if versions is None else versions))
        signed = signed.groupBy("doc_id", *GROUP).agg(*[F.sum(c).alias(c) for c in ("docs", "tokens", "chars")])
        signed = signed.where("docs != 0 or tokens != 0 or chars != 0")
        signed.write.mode("overwrite").parquet(f"{self.path}/signed/batch={batch}")
        delta = self.spark.read.schema(SIGNED).parquet(f"{self.path}/signed/batch={batch}").groupBy(*GROUP)
        delta.agg(*[F.sum(c).alias(c) for c in ("docs", "tokens", "chars")]).write.mode("overwrite").parquet(f"{self.path}/delta/batch={batch}")
        self.spark.range(1).select(F.lit(True).alias("applied")).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens, chars) over all committed batches; groups without documents go."""
        delta = self._committed("delta", "source string, lang string, tokenizer string, docs long, tokens long, chars long")
        return delta.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in ("docs", "tokens", "chars")]).where("docs != 0")
