"""A folder of tables whose rows come in committed versions.

Each batch writes its rows of each table under ``<table>/version=<n>`` and then one row into ``commits``. A version
without that row is not read, so a write that broke off leaves nothing behind that counts, and is overwritten by the next
try. A batch has a name; a name that is committed is not applied again. A version can be the base of a table: it
replaces all rows of that table before it (compaction). One writer at a time.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

COMMITS = "version int, batch string, tables array<string>, bases array<string>"


def shared_folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir; a session on one machine without that setting gets a folder of its own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="kgspark-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(rows: DataFrame, *partitions: str) -> DataFrame:
    """Rows as a table of their own in the shared folder: work that many rounds build on is not done again."""
    path = shared_folder(rows.sparkSession)
    rows.write.partitionBy(*partitions).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def dealt(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Rows by key in as many partitions as have about ``most`` rows each, from the number of rows (file footers).

    Adaptive execution joins partitions by their compressed bytes before they are read. Rows that become hundreds of
    rows behind the shuffle would then meet by the gigabyte in one task; a stated number of partitions stays.
    """
    return rows.repartition(max(rows.count() // most + 1, min(rows.sparkSession.sparkContext.defaultParallelism, 8)), *keys)


class Versions:
    """Tables of one folder, read and written by version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commits(self) -> list:
        """One row per committed batch, in order."""
        try:
            rows = self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits").collect()  # one short row per batch
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(rows, key=lambda r: r["version"])

    def begin(self, batch: str) -> int | None:
        """The version for a batch, or None when it is committed already."""
        done = self.commits()
        if any(r["batch"] == batch for r in done):
            return None
        return done[-1]["version"] + 1 if done else 1

    def put(self, table: str, version: int, rows: DataFrame, *partitions: str) -> None:
        rows.write.mode("overwrite").partitionBy(*partitions).parquet(f"{self.path}/{table}/version={version}")

    def commit(self, version: int, batch: str, tables: list[str], bases: list[str] | None = None) -> None:
        """From here on the batch counts; written last and by one task."""
        row = self.spark.createDataFrame([(version, batch, tables, bases or [])], COMMITS)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/number={version}")

    def live(self, table: str) -> list[int]:
        """The versions that hold the rows of a table."""
        done = self.commits()
        base = max((r["version"] for r in done if table in r["bases"]), default=0)
        return [r["version"] for r in done if r["version"] >= base and table in r["tables"]]

    def rows(self, table: str, schema: str) -> DataFrame:
        """All committed rows of a table since its base, with their version."""
        wanted = self.live(table)
        if not wanted:
            return self.spark.createDataFrame([], f"{schema}, version int")
        paths = [f"{self.path}/{table}/version={v}" for v in wanted]
        return self.spark.read.option("basePath", f"{self.path}/{table}").schema(f"{schema}, version int").parquet(*paths)
