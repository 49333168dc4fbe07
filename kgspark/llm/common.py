"""Shared pieces: reading tables, cutting lineage, attaching groups to members without a hot task."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group with at least this share of all rows is hot; there can be at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(df: DataFrame) -> str:
    """The folder of spark.checkpoint.dir; only a session on one machine without it (tests) gets one of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and cuts its lineage there; Spark removes the files with the last use."""
    _shared_folder(df)
    return df.checkpoint()


def new_folder(df: DataFrame) -> str:
    """A path of its own in the shared folder."""
    return f"{_shared_folder(df)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Like checkpoint, as a Parquet table: for results of which later steps read some columns only."""
    path = new_folder(df)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Bytes of one Arrow batch between Spark and its Python workers; rows of texts are wide.
ARROW_BATCH = "4m"


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session told to send batches of ARROW_BATCH, so that a task's memory doesn't hang on the texts' sizes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    return df


#: Bytes of one column that a Python task works on at once; one longer value is taken alone.
WORKED = 4 << 20


def portions(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut into portions of about WORKED bytes of a string or binary column."""
    for batch in batches:
        at = 0
        while at < len(batch):
            rest = batch.column(column)[at:]
            size = max(1, rest.nbytes)
            rows = len(rest) if size <= WORKED else max(1, len(rest) * WORKED // size)
            while rows > 1 and rest[:rows].nbytes > 2 * WORKED:
                rows //= 2
            yield batch.slice(at, rows)
            at += rows
        pa.default_memory_pool().release_unused()


def attach_groups(members: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """members joined to the one row that groups has for their key; groups[size] is the number of members.

    Hot keys (HOT_SHARE of all members and more, so at most 1 / HOT_SHARE rows) are broadcast, so the members
    of a hot key stay where they are; the others are joined by a shuffle in which no key is large.
    A null key matches nothing.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    bound = max(1, math.ceil(total * HOT_SHARE))
    hot = checkpoint(groups.where(F.col(size) >= bound))
    flagged = members.join(F.broadcast(hot), key, "left")
    is_hot = F.col(size).isNotNull()
    rest = flagged.where(~is_hot).select(*members.columns).join(groups.where(F.col(size) < bound), key)
    columns = [*members.columns, *[c for c in groups.columns if c != key]]
    return flagged.where(is_hot).select(*columns).unionByName(rest.select(*columns))
