"""Review tables: who gets scored, re-scoring, overrides and statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from kgspark.functions.numbers import round_to
from kgspark.operators.decode import first_of
from kgspark.operators.scorecards import PARTS
from kgspark.operators.staging import RELATION_KEY

Scorer = Callable[[DataFrame], DataFrame]

# Outcomes of a bulk review, statuses a manual override may set.
ALREADY, DUPLICATE, MISSING = "Already reviewed", "Duplicate entity text already reviewed", "Entity not found"
REVIEW_STATUSES = ["pending", "passed", "failed", "needs_review"]


def bulk_review_entities(ids: DataFrame, pending: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending rows to score, and ``id, outcome`` for every listed id.

    ``ids(id, ord)`` is a set of ids in order. An id is skipped when it has a review, or when its
    (text, type) has one or came earlier in the list.
    """
    done = reviews.filter("pending_entity_id IS NOT NULL").select(F.col("pending_entity_id").alias("id")).distinct()
    known = reviews.select(F.col("entity_text").alias("text"), "entity_type").distinct()
    listed = (
        ids.join(done.withColumn("done", F.lit(True)), "id", "left")
        .join(pending.withColumn("there", F.lit(True)), "id", "left")
    )
    open_ = listed.filter("done IS NULL AND there")
    fresh = first_of(open_, {"text": F.col("text"), "entity_type": F.col("entity_type")}, ["ord", "id"]).join(
        known, ["text", "entity_type"], "left_anti")
    chosen = fresh.select("id", F.lit(True).alias("chosen"))
    outcome = (
        F.when(F.col("done"), F.lit(ALREADY)).when(F.col("there").isNull(), F.lit(MISSING))
        .when(F.col("chosen"), F.lit("reviewed")).otherwise(F.lit(DUPLICATE))
    )
    outcomes = listed.select("id", "done", "there").join(chosen, "id", "left").select("id", outcome.alias("outcome"))
    return fresh.select(*pending.columns), outcomes


def bulk_review_relations(pending: DataFrame, reviews: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pending relations whose triple has no review, each triple once; and counts."""
    waiting = pending.filter("status = 'pending'")
    fresh = first_of(waiting, {k: F.col(k) for k in RELATION_KEY}, order).join(
        reviews.select(*RELATION_KEY).distinct(), RELATION_KEY, "left_anti")
    marked = waiting.select("id").join(fresh.select("id", F.lit(True).alias("chosen")), "id", "left")
    counts = marked.agg(F.count("chosen").alias("reviewed"), F.count_if(F.col("chosen").isNull()).alias("skipped"))
    return fresh, counts


def entity_review_rows(scored: DataFrame, stamp: Column, id_column: str = "id") -> DataFrame:
    """Scored pending rows in the layout of the review table."""
    c = F.col
    return scored.select(
        c(id_column).alias("pending_entity_id"), c("text").alias("entity_text"), "entity_type",
        *[c(p)["score"].alias(f"{p}_score") for p in PARTS],
        c("congruence.nearest_entity").alias("congruence_nearest_entity"),
        c("congruence.nearest_uri").alias("congruence_nearest_uri"),
        c("coverage.similar_count").alias("coverage_similar_entities_count"),
        c("coverage.is_novel").alias("coverage_is_novel"),
        c("constraint.violations").alias("constraint_violations"),
        c("constraint.type_valid").alias("constraint_type_valid"),
        c("completeness.has_type").alias("completeness_has_type"),
        c("completeness.has_context").alias("completeness_has_context"),
        c("consistency.agrees").alias("consistency_agreement"),
        "overall_score", "review_status", "recommendation", F.lit("auto").alias("reviewed_by"), stamp.alias("created_at"),
    )


def reevaluate_entities(reviews: DataFrame, pending: DataFrame, score: Scorer) -> DataFrame:
    """Every review scored again; inputs come from its pending row where there is one."""
    inputs = pending.select(F.col("id").alias("pending_entity_id"), "normalized_text", "context", "confidence", "source")
    rows = reviews.select(F.col("id").alias("review_id"), "pending_entity_id", F.col("entity_text").alias("text"), "entity_type",
                          F.col("review_status").alias("old_status"))
    return score(rows.join(inputs, "pending_entity_id", "left")).withColumnRenamed("review_status", "new_status")


def reevaluate_relations(reviews: DataFrame, pending: DataFrame, score: Scorer) -> DataFrame:
    inputs = pending.select(F.col("id").alias("pending_relation_id"), "context", "confidence", "source")
    rows = reviews.select(F.col("id").alias("review_id"), "pending_relation_id", "source_entity", "source_type", "relation_type",
                          "target_entity", "target_type", F.col("review_status").alias("old_status"))
    return score(rows.join(inputs, "pending_relation_id", "left")).withColumnRenamed("review_status", "new_status")


def review_override(reviews: DataFrame, updates: DataFrame) -> DataFrame:
    """Manual statuses of ``updates(id, status, notes)``; unknown statuses change nothing."""
    u = updates.filter(F.col("status").isin(REVIEW_STATUSES)).select("id", F.col("status").alias("_s"), F.col("notes").alias("_n"))
    s, n = F.col("_s"), F.col("_n")
    out = reviews.join(u, "id", "left").withColumns(
        {
            "review_status": F.coalesce(s, F.col("review_status")),
            "reviewed_by": F.when(s.isNotNull(), F.lit("manual")).otherwise(F.col("reviewed_by")),
            "review_notes": F.when(n != "", n).otherwise(F.col("review_notes")),
            "recommendation": F.when(s == "passed", F.lit("approve")).when(s == "failed", F.lit("reject"))
            .otherwise(F.col("recommendation")),
        }
    )
    return out.select(*reviews.columns)


def latest_review(reviews: DataFrame, link: str = "pending_entity_id") -> DataFrame:
    newest = F.max_by(F.struct(*reviews.columns), F.struct("created_at", "id"))
    return reviews.filter(F.col(link).isNotNull()).groupBy(link).agg(newest.alias("r")).select("r.*")


SCORES = [*[f"{p}_score" for p in PARTS], "overall_score"]


def _cells(reviews: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Counts and sums per combination of a few keys: all that the statistics need, in one pass."""
    sums = [F.sum(s).alias(f"sum_{s}") for s in SCORES] + [F.count(s).alias(f"n_{s}") for s in SCORES]
    return reviews.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count(F.lit(1)).alias("n"), *sums)


def _averages() -> list[Column]:
    return [round_to(F.sum(f"sum_{s}") / F.sum(f"n_{s}"), 3).alias(s.removesuffix("_score")) for s in SCORES]


def entity_review_stats(reviews: DataFrame) -> DataFrame:
    """``stat, name, value``: total, by status, by recommendation, averages, score bands."""
    o = F.col("overall_score")
    band = F.when(o >= 0.8, "excellent").when(o >= 0.6, "good").when(o >= 0.4, "fair").when(o.isNotNull(), "poor")
    cells = _cells(reviews, {"review_status": F.col("review_status"), "recommendation": F.col("recommendation"), "band": band})
    item = lambda stat, name: F.struct(F.lit(stat).alias("stat"), name.alias("name"), F.col("n").alias("n"))
    rows = F.array(
        item("total", F.lit("")),
        item("status", F.col("review_status")),
        F.when(F.col("recommendation").isNotNull(), item("recommendation", F.col("recommendation"))),
        F.when(F.col("band").isNotNull(), item("band", F.col("band"))),
    )
    counts = cells.select(F.explode(rows).alias("x")).filter("x IS NOT NULL").select("x.*").groupBy("stat", "name").agg(
        F.sum("n").cast("double").alias("value"))
    mean = cells.agg(*_averages())
    names = [s.removesuffix("_score") for s in SCORES]
    means = mean.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(n, F.lit(0.0)).alias("value")) for n in names])).alias("x"))
    return counts.unionByName(means.select(F.lit("average").alias("stat"), "x.name", "x.value"))


def relation_review_stats(reviews: DataFrame) -> DataFrame:
    """One row: total, four statuses, six averages."""
    cells = _cells(reviews, {"review_status": F.col("review_status")})
    by = [F.coalesce(F.sum(F.when(F.col("review_status") == s, F.col("n"))), F.lit(0)).alias(s) for s in ("passed", "failed", "needs_review", "pending")]
    return cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *by, *[a for a in _averages()])
