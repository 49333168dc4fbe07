"""Staging tables: new findings wait here until they are reviewed and approved.

Tables go in and come out as DataFrames; a job writes the result where it wants it. A batch
behaves like one row after another: what the batch itself adds also counts as present.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from kgspark.functions.text import strip
from kgspark.operators.decode import first_of
from kgspark.operators.prepare import CONTEXT_LIMIT, truncate_context
from kgspark.sources.versions import written

MAX_PAGE = 200


def _new_only(rows: DataFrame, keys: list[str], present: DataFrame, order: list[str]) -> DataFrame:
    """First row per key that the table does not have. Copies are reduced before the anti join."""
    once = first_of(rows, {k: F.col(k) for k in keys}, order)
    return once.join(present.select(*keys), keys, "left_anti")


def stage_entities(incoming: DataFrame, pending: DataFrame, order: list[str], context_limit: int = CONTEXT_LIMIT) -> DataFrame:
    """Entities that are not exact matches and not already pending under the same text and type."""
    found = incoming.filter(~F.col("validation_status").eqNullSafe("exact_match"))
    rows = _new_only(found, ["text", "entity_type"], pending.filter("status = 'pending'"), order)
    return rows.withColumns({"context": truncate_context(F.col("context"), context_limit), "status": F.lit("pending")})


def stage_joint_entities(incoming: DataFrame, pending: DataFrame, order: list[str], context_limit: int = CONTEXT_LIMIT) -> DataFrame:
    """The same for joint extraction: texts are stripped, blank ones dropped, nothing is linked yet."""
    bare = incoming.withColumns({c: strip(F.coalesce(c, F.lit(""))) for c in ("text", "entity_type")})
    rows = _new_only(bare.filter("text <> '' AND entity_type <> ''"), ["text", "entity_type"], pending.filter("status = 'pending'"), order)
    return rows.withColumns(
        {
            "validation_status": F.lit("not_found"),
            "source": F.lit("langextract"),
            "confidence": F.lit(None).cast("double"),
            "context": truncate_context(F.col("context"), context_limit),
            "status": F.lit("pending"),
        }
    )


RELATION_KEY = ["source_entity", "relation_type", "target_entity"]


def stage_relations(incoming: DataFrame, pending: DataFrame, order: list[str], context_limit: int = CONTEXT_LIMIT) -> DataFrame:
    """Relations that are in the table under no status; a missing context becomes the document's.

    ``incoming`` may carry ``document_text`` for that.
    """
    bare = incoming.withColumns({c: strip(F.coalesce(c, F.lit(""))) for c in RELATION_KEY})
    full = bare.filter(" AND ".join(f"{c} <> ''" for c in RELATION_KEY))
    rows = _new_only(full, RELATION_KEY, pending, order)
    own = F.when(F.col("context") != "", F.col("context"))
    whole = F.col("document_text") if "document_text" in incoming.columns else F.lit(None).cast("string")
    context = truncate_context(F.coalesce(own, whole, F.lit("")), context_limit)
    return rows.withColumns({"context": context, "status": F.lit("pending")}).drop("document_text")


def stage_relations_raw(incoming: DataFrame, pending: DataFrame) -> DataFrame:
    """Append as they are."""
    return pending.unionByName(incoming.withColumn("status", F.lit("pending")), allowMissingColumns=True)


@dataclass(frozen=True)
class Listing:
    """What to list: equality filters, a substring over some columns, a score range, order and page."""

    equal: dict[str, str] = field(default_factory=dict)
    search: str | None = None
    search_in: tuple[str, ...] = ()
    min_score: float | None = None
    max_score: float | None = None
    sort_by: str | None = None
    descending: bool = False
    page: int = 1
    page_size: int = 50


# Columns a listing may be sorted by; any other choice gives the newest first.
SORTABLE = {
    "pending_entities": ["text", "entity_type", "validation_status", "similarity_score", "source", "created_at"],
    "pending_relations": ["source_entity", "relation_type", "target_entity", "confidence", "source", "created_at"],
    "entity_reviews": ["entity_text", "entity_type", "congruence_score", "coverage_score", "constraint_score",
                       "completeness_score", "consistency_score", "overall_score", "review_status"],
    "relation_reviews": ["source_entity", "congruence_score", "coverage_score", "constraint_score",
                         "completeness_score", "consistency_score", "overall_score", "review_status"],
}
SEARCHED = {
    "pending_entities": ("text", "normalized_text"),
    "pending_relations": ("source_entity", "target_entity"),
    "entity_reviews": ("entity_text",),
    "relation_reviews": ("source_entity", "target_entity"),
}


def matching(rows: DataFrame, listing: Listing) -> DataFrame:
    """Rows that pass the filters. Wildcards in the search text keep their meaning."""
    for c, v in listing.equal.items():
        rows = rows.filter(F.col(c) == v)
    if listing.min_score is not None:
        rows = rows.filter(F.col("overall_score") >= listing.min_score)
    if listing.max_score is not None:
        rows = rows.filter(F.col("overall_score") <= listing.max_score)
    if listing.search:
        hit: Column = F.lit(False)
        for c in listing.search_in:
            hit = hit | F.coalesce(F.col(c).ilike(f"%{listing.search}%"), F.lit(False))
        rows = rows.filter(hit)
    return rows


def listing_order(listing: Listing, sortable: list[str]) -> list[Column]:
    """The sort key of a listing; ties are ordered by id."""
    if listing.sort_by not in sortable:
        return [F.col("created_at").desc()]
    c = F.col(listing.sort_by)
    return [c.desc_nulls_last() if listing.descending else c.asc_nulls_first()]


def list_page(rows: DataFrame, listing: Listing, sortable: list[str]) -> DataFrame:
    """One page; ties are ordered by id. The plan keeps only offset + page rows per task."""
    if not 1 <= listing.page_size <= MAX_PAGE:
        raise ValueError(f"page_size must be 1..{MAX_PAGE}")
    return (
        matching(rows, listing).orderBy(*listing_order(listing, sortable), "id")
        .offset((listing.page - 1) * listing.page_size).limit(listing.page_size)
    )


def list_after(rows: DataFrame, listing: Listing, sortable: list[str], value, last_id) -> DataFrame:
    """The page that follows the row with sort value ``value`` and id ``last_id``.

    A range on the sort key: a task keeps one page of rows, however deep the page is.
    """
    by = listing.sort_by if listing.sort_by in sortable else "created_at"
    down = listing.descending if listing.sort_by in sortable else True
    c, later = F.col(by), F.col("id") > F.lit(last_id)
    if value is None:
        rest = c.isNull() & later if down else c.isNotNull() | later
    else:
        v = F.lit(value)
        rest = (c == v) & later
        rest = rest | ((c < v) | c.isNull() if down else c > v)
    order = c.desc_nulls_last() if down else c.asc_nulls_first()
    return matching(rows, listing).filter(rest).orderBy(order, "id").limit(listing.page_size)


def list_total(rows: DataFrame, listing: Listing) -> DataFrame:
    return matching(rows, listing).agg(F.count(F.lit(1)).alias("total"))


def attach_reviews(page: DataFrame, reviews: DataFrame, link: str) -> DataFrame:
    """Status and score of the latest review of each row of a page (at most 200 rows)."""
    few = reviews.join(F.broadcast(page.select(F.col("id").alias(link))), link)
    last = few.groupBy(F.col(link).alias("id")).agg(
        F.max_by(F.struct("review_status", "overall_score"), F.col("id")).alias("r"))
    return page.join(last.select("id", "r.review_status", "r.overall_score"), "id", "left")


def reviewed_only(pending: DataFrame, reviews: DataFrame, link: str) -> DataFrame:
    return pending.join(reviews.select(F.col(link).alias("id")), "id", "left_semi")


def not_reviewed(pending: DataFrame, reviews: DataFrame, link: str) -> DataFrame:
    return pending.join(reviews.filter(F.col(link).isNotNull()).select(F.col(link).alias("id")), "id", "left_anti")


def pending_stats(pending: DataFrame) -> DataFrame:
    """``stat, name, n``: rows by status; by type and by source among pending ones.

    One pass reduces the table to its few (status, type, source) combinations.
    """
    cells = pending.groupBy("status", "entity_type", "source").agg(F.count(F.lit(1)).alias("n"))
    item = lambda stat, c: F.struct(F.lit(stat).alias("stat"), F.col(c).alias("name"), F.col("n").alias("n"))
    waiting = F.col("status") == "pending"
    rows = F.array(item("status", "status"), F.when(waiting, item("type", "entity_type")), F.when(waiting, item("source", "source")))
    return cells.select(F.explode(rows).alias("x")).filter("x IS NOT NULL").select("x.*").groupBy("stat", "name").agg(F.sum("n").alias("n"))


def relation_pending_stats(relations: DataFrame) -> DataFrame:
    """``stat, name, n``: total, the three statuses, and rows by source."""
    cells = relations.groupBy("status", "source").agg(F.count(F.lit(1)).alias("n"))
    item = lambda stat, name: F.struct(F.lit(stat).alias("stat"), name.alias("name"), F.col("n").alias("n"))
    known = F.col("status").isin("pending", "approved", "rejected")
    rows = F.array(item("total", F.lit("")), F.when(known, item("status", F.col("status"))), item("source", F.col("source")))
    return cells.select(F.explode(rows).alias("x")).filter("x IS NOT NULL").select("x.*").groupBy("stat", "name").agg(F.sum("n").alias("n"))


def bulk_action(pending: DataFrame, ids: DataFrame, action: str) -> tuple[DataFrame, DataFrame]:
    """The table after deleting, rejecting or approving ``ids(id)``, and the number of rows affected.

    Only pending rows can be approved.
    """
    if action not in ("delete", "reject", "approve"):
        raise ValueError(f"unknown action {action!r}")
    listed = ids.select("id").distinct()
    if action == "delete":
        return bulk_delete(pending, ids)
    marked = pending.join(listed.withColumn("listed", F.lit(True)), "id", "left")
    hit = F.coalesce("listed", F.lit(False))
    if action == "approve":
        hit = hit & (F.col("status") == "pending")
    new = F.lit("rejected" if action == "reject" else "approved")
    return (
        marked.withColumn("status", F.when(hit, new).otherwise(F.col("status"))).drop("listed"),
        marked.agg(F.count_if(hit).alias("affected_count")),
    )


def bulk_delete(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    listed = ids.select("id").distinct()
    found = rows.join(listed, "id", "left_semi")
    return rows.join(listed, "id", "left_anti"), found.agg(F.count(F.lit(1)).alias("affected_count"))


def _decide(wanted: DataFrame, held: DataFrame, states: DataFrame | None) -> DataFrame:
    """(id, accepted) of the edits that can be decided now.

    ``wanted(id, k_text, k_type)`` are the edits that want a pair; ``held`` are the rows that have a pair or would take
    one: (k_text, k_type, owner, moves, takes). ``states(id, accepted)`` are earlier decisions. Everything about a
    pair is one row of minima and maxima, whatever the number of edits that want it.
    """
    key = ["k_text", "k_type"]
    if states is None:
        rows, todo = held.withColumn("accepted", F.lit(None).cast("boolean")), wanted
    else:
        told = states.select(F.col("id").alias("owner"), "accepted")
        rows, todo = held.join(told, "owner", "left"), wanted.join(states, "id", "left_anti")
    accepted, open_ = F.col("accepted"), F.col("accepted").isNull()
    stays = ~F.col("takes") & (~F.col("moves") | F.coalesce(~accepted, F.lit(False)))
    leaves = ~F.col("takes") & F.col("moves")
    ends = lambda c, name: [F.min(F.when(c, F.col("owner"))).alias(f"{name}_lo"), F.max(F.when(c, F.col("owner"))).alias(f"{name}_hi")]
    pairs = rows.groupBy(*key).agg(
        *ends(stays, "stay"), *ends(leaves, "leave"), *ends(leaves & open_, "open"),
        F.min(F.when(F.col("takes") & accepted, F.col("owner"))).alias("taken"),
        F.min(F.when(F.col("takes") & open_, F.col("owner"))).alias("next"),
    )
    me = F.col("id")
    # Held by a row that stays, or by one whose edit comes later; or taken by an accepted edit before.
    lost = (F.col("stay_lo") != me) | (F.col("stay_hi") != me) | (F.col("leave_hi") > me) | (F.col("taken") < me)
    # Another edit before this one is still open, and would release the pair or take it.
    waits = (F.col("open_lo") < me) | (F.col("next") < me)
    judged = todo.join(pairs, key, "left").withColumns({"lost": F.coalesce(lost, F.lit(False)), "waits": F.coalesce(waits, F.lit(False))})
    return judged.filter("lost OR NOT waits").select("id", (~F.col("lost")).alias("accepted"))


def apply_edits(pending: DataFrame, reviews: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edited pending rows and reviews, and the ids of rejected edits.

    ``edits(id, text, entity_type, normalized_text, status)``, null where nothing changes, at most
    one per id. The result is that of applying them one by one in order of id: an edit of text or type is rejected
    when at its turn another pending row or another row's review has the new pair. So an edit can take a pair that an
    earlier accepted one released. Edits are decided in rounds, all at once that wait for no other; as many rounds
    as the longest chain of edits that wait for each other. Decisions of a round are written to the shared folder.
    """
    e = edits.select("id", *[F.col(c).alias(f"new_{c}") for c in ("text", "entity_type", "normalized_text", "status")])
    joined = pending.join(e.withColumn("edited", F.lit(True)), "id", "left")
    value = lambda c: F.coalesce(f"new_{c}", c)
    changes = "new_text IS NOT NULL OR new_entity_type IS NOT NULL"
    wanted = joined.filter(changes).select("id", value("text").alias("k_text"), value("entity_type").alias("k_type"))
    linked = reviews.filter("pending_entity_id IS NOT NULL").select(
        F.col("pending_entity_id").alias("id"), F.col("entity_text").alias("text"), "entity_type")
    linked = linked.join(joined.filter(changes).select("id", "new_text", "new_entity_type"), "id", "left")
    holders = joined.select("id", "text", "entity_type", "new_text", "new_entity_type").unionByName(linked)
    moves = F.coalesce((value("text") != F.col("text")) | (value("entity_type") != F.col("entity_type")), F.lit(False))
    row = lambda text, kind, m, takes: F.struct(text.alias("k_text"), kind.alias("k_type"), F.col("id").alias("owner"), m.alias("moves"), F.lit(takes).alias("takes"))
    old = row(F.col("text"), F.col("entity_type"), moves, False)
    # A row without text or type has no pair that can be the same as another's, but its edit may give it one.
    fresh = moves | F.col("text").isNull() | F.col("entity_type").isNull()
    new = F.when(fresh & F.expr(changes), row(value("text"), value("entity_type"), F.lit(True), True))
    held = holders.select(F.explode(F.array_compact(F.array(old, new))).alias("h")).select("h.*")
    held = held.join(wanted.select("k_text", "k_type").distinct(), ["k_text", "k_type"], "left_semi")
    wanted, held = written(wanted), written(held)
    total, states = wanted.count(), None
    while states is None or states.count() < total:
        now = _decide(wanted, held, states)
        states = written(now if states is None else states.unionByName(now))
    conflicts = states.filter("NOT accepted").select("id")
    ok = joined.join(conflicts.withColumn("conflict", F.lit(True)), "id", "left")
    free = F.col("conflict").isNull()
    changed = ok.withColumns({c: F.when(free, value(c)).otherwise(F.col(c)) for c in ("text", "entity_type", "normalized_text", "status")})
    new_pending = changed.select(*pending.columns)
    applied = e.join(conflicts, "id", "left_anti").select(F.col("id").alias("pending_entity_id"), "new_text", "new_entity_type")
    new_reviews = reviews.join(applied, "pending_entity_id", "left").withColumns(
        {"entity_text": F.coalesce("new_text", "entity_text"), "entity_type": F.coalesce("new_entity_type", "entity_type")}
    ).select(*reviews.columns)
    return new_pending, new_reviews, conflicts


def apply_relation_edits(relations: DataFrame, edits: DataFrame, columns: list[str]) -> DataFrame:
    """Relation edits have no conflict check."""
    e = edits.select("id", *[F.col(c).alias(f"new_{c}") for c in columns])
    out = relations.join(e, "id", "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in columns})
    return out.select(*relations.columns)
