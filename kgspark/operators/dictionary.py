"""The entity dictionary: what a graph knows about each subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kgspark.functions.labels import local_name
from kgspark.functions.text import normalize_text
from kgspark.vocab import LABEL_PREDICATES, RDF_TYPE


def build_entity_dict(triples: DataFrame) -> DataFrame:
    """``uri, labels, norm_labels, types`` with sorted arrays; subjects without labels are kept.

    One shuffle on the subject. Labels and classes of one subject are few; facts about it
    that are neither are dropped before the arrays are made.
    """
    label = F.when(F.col("p").isin(LABEL_PREDICATES), F.col("o"))
    cls = F.when(F.col("p") == RDF_TYPE, F.col("o"))
    return (
        triples.groupBy(F.col("s").alias("uri"))
        .agg(F.array_sort(F.collect_set(label)).alias("labels"), F.array_sort(F.collect_set(cls)).alias("types"))
        .select("uri", "labels", F.transform("labels", normalize_text).alias("norm_labels"), "types")
    )


def label_table(entities: DataFrame) -> DataFrame:
    """One row per entity and label: ``uri, label, norm, type_names``.

    ``type_names`` are the local names of the classes in class order, so the first one is the
    class that a match reports.
    """
    return (
        entities.select("uri", F.transform("types", local_name).alias("type_names"), F.explode("labels").alias("label"))
        .withColumn("norm", normalize_text(F.col("label")))
    )
