"""Linking that is kept up to date: batches of new texts and of changed labels.

``MatchStore`` keeps, for every text seen, its best k entities of each class signature, with the version that
found them. A batch compares only

- new texts, and texts that lose an entity they had, with all labels,
- all other texts with the labels that are new,

and merges the best k. Both sides of the similarity join are stored as index entries by class of lengths and item
(``similarity``), so a batch reads only the classes of lengths that its own texts and labels reach, and within them
only entries with an item in common are brought together. Results equal those of a full run (``linking.find_matches``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kgspark.functions.text import normalize_text
from kgspark.operators import linking, similarity
from kgspark.sources.versions import Versions

LABELS = "uri string, label string, norm string, type_names array<string>"
MATCHED = "q string, uri string, kg_label string, type_names array<string>, score double"
RANKS = "ch string, i int, rank int"


class MatchStore:
    """Matches of all texts seen so far with all labels so far, under one k and one threshold."""

    def __init__(self, spark: SparkSession, path: str, k: int = 5, threshold: float = 0.7):
        self.store, self.k, self.threshold = Versions(spark, path), k, threshold

    def labels(self) -> DataFrame:
        """The label table as it stands: rows added and not removed since."""
        rows = self.store.rows("labels", f"{LABELS}, change int")
        cols = [c.split()[0] for c in LABELS.split(", ")]
        return rows.groupBy(*cols).agg(F.sum("change").alias("n")).filter("n > 0").select(*cols)

    def matches(self) -> DataFrame:
        """The rows of each text's last version; a text without match has none."""
        rows = self.store.rows("matches", MATCHED)
        last = rows.groupBy("q").agg(F.max("version").alias("version"))
        return rows.join(last, ["q", "version"]).filter("uri IS NOT NULL").drop("version")

    def _best(self, rows: DataFrame) -> DataFrame:
        """Best label of each entity, then the best k entities of each text and class signature."""
        order = F.struct((-F.col("score")).alias("a"), F.col("kg_label").alias("b"))
        each = rows.groupBy("q", "uri").agg(F.min_by(F.struct("kg_label", "type_names", "score"), order).alias("b")).select("q", "uri", "b.*")
        signed = each.withColumn("sig", F.array_join("type_names", "|"))
        return linking.top_k(signed, ["q", "sig"], self.k).drop("rank", "sig")

    def _ranks(self, added: DataFrame) -> tuple[dict, DataFrame | None]:
        """The order of items, fixed with the first labels: any order is right as long as all entries share it."""
        held = {(r["ch"], r["i"]): r["rank"] for r in self.store.rows("ranks", RANKS).collect()}  # at most ORDERED rows
        if held:
            return held, None
        made = similarity.item_ranks(added)
        if not made:
            return made, None
        rows = self.store.spark.createDataFrame([(ch, i, rank) for (ch, i), rank in made.items()], RANKS)
        return made, rows

    def _index(self, table: str, schema: str, parts: DataFrame) -> DataFrame:
        """Stored entries of the classes of lengths that a batch has."""
        wanted = [r["part"] for r in parts.select("part").distinct().collect()]  # one row per class of lengths
        return self.store.rows(table, schema).filter(F.col("part").isin(wanted)).drop("version")

    def _score(self, texts: DataFrame, asked: DataFrame, labels: DataFrame, filed: DataFrame) -> DataFrame:
        return self._best(linking.score_candidates(texts, labels, self.k, self.threshold, filed=filed, asked=asked))

    def apply(self, batch: str, texts: DataFrame, added: DataFrame, removed: DataFrame | None = None) -> bool:
        """Takes in texts (``text``) and changes of the label table; False when the batch was applied before.

        ``added`` and ``removed`` are rows of a label table. An entity whose classes change is removed with its old
        rows and added with the new ones; a label that the table has already is not added again.
        """
        version = self.store.begin(batch)
        if version is None:
            return False
        cols = [c.split()[0] for c in LABELS.split(", ")]
        before = self.labels()
        gone = before.join((removed if removed is not None else before.limit(0)).select(*cols).distinct(), cols, "left_semi")
        fresh = added.select(*cols).distinct().join(before, cols, "left_anti")
        self.store.put("labels", version, fresh.withColumn("change", F.lit(1)).unionByName(gone.withColumn("change", F.lit(-1))))
        ranks, made = self._ranks(fresh)
        if made is not None:
            self.store.put("ranks", version, made)
        changed = self.store.spark.read.parquet(f"{self.store.path}/labels/version={version}")
        fresh, gone = (changed.filter(f"change = {c}").select(*cols) for c in (1, -1))
        now = before.join(gone, cols, "left_anti").unionByName(fresh)

        seen = self.store.rows("texts", "q string").select("q")
        arrived = texts.select(normalize_text(F.col("text")).alias("q")).filter("q IS NOT NULL").distinct().join(seen, "q", "left_anti")
        self.store.put("texts", version, arrived)
        arrived = self.store.spark.read.schema("q string").parquet(f"{self.store.path}/texts/version={version}")
        new_names = fresh.select("norm").distinct().join(before.select("norm"), "norm", "left_anti")
        self.store.put("filed", version, similarity.file_labels(new_names, ranks, self.threshold), "part")
        self.store.put("asked", version, similarity.ask_texts(arrived, ranks, self.threshold), "part")

        kept = self.matches()
        lost = kept.join(gone.select("uri", F.col("label").alias("kg_label")), ["uri", "kg_label"], "left_semi").select("q").distinct()
        again = arrived.unionByName(lost).distinct()
        asked_again = similarity.ask_texts(again, ranks, self.threshold)
        stored_names = self._index("filed", similarity.LABEL_ROWS, asked_again).unionByName(
            self.store.spark.read.schema(similarity.LABEL_ROWS).parquet(f"{self.store.path}/filed/version={version}"))
        full = self._score(again, asked_again, now, stored_names)
        filed_new = similarity.file_labels(fresh.select("norm").distinct(), ranks, self.threshold)
        others = seen.join(lost, "q", "left_anti")
        asked_old = self._index("asked", similarity.QUERY_ROWS, filed_new).join(lost, "q", "left_anti")
        delta = self._score(others, asked_old, fresh, filed_new)
        merged = self._best(kept.join(delta.select("q").distinct(), "q", "left_semi").unionByName(delta))
        none = again.join(full.select("q").distinct(), "q", "left_anti").select("q", *[F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in MATCHED.split(", ")[1:])])
        self.store.put("matches", version, full.unionByName(merged).unionByName(none))
        self.store.commit(version, batch, ["labels", "texts", "filed", "asked", "matches", *(["ranks"] if made is not None else [])])
        return True

    def compact(self, batch: str) -> bool:
        """All matches and labels as one version; what is read stays the same."""
        version = self.store.begin(batch)
        if version is None:
            return False
        self.store.put("labels", version, self.labels().withColumn("change", F.lit(1)))
        self.store.put("matches", version, self.matches())
        self.store.commit(version, batch, ["labels", "matches"], ["labels", "matches"])
        return True

    def find_matches(self, mentions: DataFrame) -> DataFrame:
        """Mentions with ``kg_matches``, as ``linking.find_matches`` gives them, without comparing anything."""
        m = mentions.withColumn("q", normalize_text(F.col("text")))
        found = linking.as_matches(linking.top_k(self.matches(), ["q"], self.k), ["q"])
        return linking.attach(m, found, ["q"])
