"""A maintained index of character grams for containment searches.

Built once, brought up to date by batches of added and removed texts, and read by every search: a search reads
the buckets of its needles' rarest grams only. Postings of removed texts stay until the next compaction; removed texts
are no hits because pairs are joined to the texts that are live.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kgspark.operators.similarity import POSTINGS, gram_postings, hay_number, looked_up, rarest_grams
from kgspark.sources.versions import Versions

BUCKETS = 64  # folders of the posting table; a search reads those of its grams
HAYS = "hay string, hay_no bigint, change int"
FREQUENCY = "gram string, n bigint"


class GramIndex:
    """Texts (``hay``) with their grams, under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = Versions(spark, path)

    def _states(self) -> DataFrame:
        """(hay, hay_no, n): every text that was ever filed; n is 1 for live ones and 0 for removed ones."""
        return self.store.rows("hays", HAYS).groupBy("hay", "hay_no").agg(F.sum("change").alias("n"))

    def hays(self) -> DataFrame:
        return self._states().filter("n > 0").select("hay", "hay_no")

    def frequency(self) -> DataFrame:
        """(gram, df): live texts with each gram, from the counts of the batches."""
        return self.store.rows("frequency", FREQUENCY).groupBy("gram").agg(F.sum("n").alias("df")).filter("df > 0")

    @staticmethod
    def _bucketed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.hash("gram"), F.lit(BUCKETS)))

    def apply(self, batch: str, added: DataFrame, removed: DataFrame | None = None) -> bool:
        """Adds and removes texts (``hay``); False when the batch was applied before. Null and empty texts are left out.

        Texts that are live already are not added, others are not removed, and a text in both stays as it was.
        """
        version = self.store.begin(batch)
        if version is None:
            return False
        wish = added.select("hay", F.lit(1).alias("change"))
        if removed is not None:
            wish = wish.unionByName(removed.select("hay", F.lit(-1).alias("change")))
        wish = wish.filter("hay <> ''").distinct().groupBy("hay").agg(F.sum("change").alias("change")).filter("change <> 0")
        states = self._states().select("hay", "n")
        told = wish.join(states, "hay", "left").filter("(change = 1) = (coalesce(n, 0) = 0)")
        self.store.put("hays", version, told.select("hay", hay_number().alias("hay_no"), F.col("change").cast("int").alias("change"), F.col("n").isNull().alias("first")))
        told = self.store.spark.read.parquet(f"{self.store.path}/hays/version={version}")
        self.store.put("postings", version, self._bucketed(gram_postings(told.filter("first"))), "bucket")
        grams = lambda change: gram_postings(told.filter(f"change = {change}")).groupBy("gram").agg((change * F.count(F.lit(1))).alias("n"))
        self.store.put("frequency", version, grams(1).unionByName(grams(-1)))
        self.store.commit(version, batch, ["hays", "postings", "frequency"])
        return True

    def compact(self, batch: str) -> bool:
        """One version with the live texts and their postings only."""
        version = self.store.begin(batch)
        if version is None:
            return False
        live = self.hays()
        self.store.put("hays", version, live.withColumn("change", F.lit(1)))
        self.store.put("postings", version, self._bucketed(gram_postings(live)), "bucket")
        self.store.put("frequency", version, gram_postings(live).groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
        tables = ["hays", "postings", "frequency"]
        self.store.commit(version, batch, tables, tables)
        return True

    def contained_pairs(self, needles: DataFrame) -> DataFrame:
        """``needle, hay`` for every live text that contains the needle; needles are distinct and not empty."""
        rarest = rarest_grams(needles, self.frequency())
        buckets = [r["bucket"] for r in self._bucketed(rarest).select("bucket").distinct().collect()]  # at most BUCKETS
        postings = self.store.rows("postings", f"{POSTINGS}, bucket int").filter(F.col("bucket").isin(buckets))
        return looked_up(rarest, postings.select("gram", "hay_no"), self.hays())
