"""Five-part quality scorecards of entities and relations.

Each part is a column expression; the order of additions is the order of the rules, so
that doubles come out the same everywhere. Weights, thresholds and settings are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from kgspark import vocab
from kgspark.functions.labels import literal_map
from kgspark.functions.numbers import round_to
from kgspark.functions.text import contains_any, normalize_text, split_words, strip
from kgspark.operators.linking import as_matches, score_candidates, top_k
from kgspark.schemas import MATCHES

# Weights of the five parts, thresholds of the decision.
WEIGHTS = {"congruence": 0.25, "coverage": 0.15, "constraint": 0.25, "completeness": 0.15, "consistency": 0.20}
PARTS = list(WEIGHTS)


def _check(weights: dict[str, float], pass_at: float, review_at: float) -> None:
    if abs(sum(weights.values()) - 1) > 0.01:
        raise ValueError("weights must sum to 1")
    if pass_at <= review_at:
        raise ValueError("the pass threshold must be above the review threshold")


@dataclass(frozen=True)
class EntityConfig:
    # The defaults.
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    pass_at: float = 0.75
    review_at: float = 0.50
    min_similarity: float = 0.7
    exact_bonus: float = 0.2
    novelty_count: int = 3
    novelty_bonus: float = 0.3
    min_length: int = 2
    max_length: int = 200
    penalty: float = 0.25
    required: tuple[str, ...] = ("type", "text")
    optional_weight: float = 0.15
    agreement_bonus: float = 0.3
    base_score: float = 0.5

    def __post_init__(self):
        _check(self.weights, self.pass_at, self.review_at)
        if self.min_length >= self.max_length:
            raise ValueError("min_length must be below max_length")


@dataclass(frozen=True)
class RelationConfig:
    # The defaults.
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    pass_at: float = 0.75
    review_at: float = 0.50
    type_penalty: float = 0.3
    kg_bonus: float = 0.2
    novelty_count: int = 3
    novelty_bonus: float = 0.3
    penalty: float = 0.25
    min_confidence: float = 0.3
    require_context: bool = False
    required: tuple[str, ...] = ("source_entity", "target_entity", "relation_type", "source_type", "target_type")
    optional_weight: float = 0.15
    agreement_bonus: float = 0.3
    base_score: float = 0.5

    def __post_init__(self):
        _check(self.weights, self.pass_at, self.review_at)


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _total(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted sum in the order of the parts, rounded to 3."""
    out = None
    for name in PARTS:
        term = parts[name] * F.lit(weights[name])
        out = term if out is None else out + term
    return round_to(out, 3)


def _subtract(rules: list[tuple[Column, Column | float]]) -> Column:
    """1 minus the amounts of the rules that hold, one after another."""
    score = F.lit(1.0)
    for holds, amount in rules:
        amount = amount if isinstance(amount, Column) else F.lit(amount)
        score = F.when(holds, score - amount).otherwise(score)
    return score


# Entities


def kg_evidence(entities: DataFrame, labels: DataFrame) -> DataFrame:
    """Entities with their ten best matches from 0.5 on, whatever their class."""
    e = entities.withColumn("q", normalize_text(F.col("text")))
    found = as_matches(top_k(score_candidates(e.select("q"), labels, 10, 0.5), ["q"], 10), ["q"])
    none = F.array().cast(MATCHES)
    return e.join(found, "q", "left").withColumn("kg_matches", F.coalesce("kg_matches", none)).drop("q")


def entity_congruence(matches: Column | None, cfg: EntityConfig) -> Column:
    """Nearness to the best match; 0.5 without one. ``matches`` is null-free or None without a graph."""
    kind = "struct<score:double,nearest_entity:string,nearest_uri:string,embedding_distance:double>"
    nothing = F.struct(F.lit(0.5).alias("score"), F.lit(None).cast("string").alias("nearest_entity"),
                       F.lit(None).cast("string").alias("nearest_uri"), F.lit(None).cast("double").alias("embedding_distance")).cast(kind)
    if matches is None:
        return nothing
    best = F.get(matches, F.lit(0))
    s = best["similarity_score"]
    score = F.when(s >= 0.95, F.least(F.lit(1.0), s + cfg.exact_bonus)).otherwise(s)
    hit = F.struct(score.alias("score"), best["kg_label"].alias("nearest_entity"), best["kg_uri"].alias("nearest_uri"),
                   (1.0 - s).alias("embedding_distance")).cast(kind)
    return F.when(s >= cfg.min_similarity, hit).otherwise(nothing)


def entity_coverage(matches: Column | None, cfg: EntityConfig) -> Column:
    def made(score, novel, gap, increase, count):
        return F.struct(score.alias("score"), count.cast("int").alias("similar_count"), F.lit(novel).alias("is_novel"),
                        F.lit(gap).alias("fills_gap"), F.lit(increase).alias("coverage_increase"))

    if matches is None:
        return made(F.lit(0.8), True, False, 0.0, F.lit(0))
    n, best = F.size(matches), F.get(matches, F.lit(0))["similarity_score"]
    few = n < cfg.novelty_count
    return (
        F.when(n == 0, made(F.lit(0.5 + cfg.novelty_bonus), True, True, 5.0, n))
        .when(few & (best < 0.8), made(F.lit(0.5 + cfg.novelty_bonus * 0.7), True, True, 3.0, n))
        .when(few, made(F.lit(0.5), False, False, 0.0, n))
        .otherwise(made(F.greatest(F.lit(0.3), 0.6 - 0.3 * best), False, False, 0.0, n))
    )


def type_violations(text: Column, entity_type: Column) -> Column:
    """Messages of the rules that tie wording to a type. The messages."""
    low, kind = F.lower(text), F.lower(entity_type)
    words = split_words(low)
    n = F.size(words)
    people = F.size(F.filter(words, lambda w: w.isin(vocab.POPULATION_WORDS)))
    counted = kind.isin(vocab.COUNTED_TYPES)
    rules = [
        (((people >= 2) | ((n > 5) & (people >= 1))) & counted,
         F.concat(F.lit("Text appears to describe a patient population, not a "), entity_type)),
        ((n > 8) & counted,
         F.concat(F.lit("Entity text too complex for type '"), entity_type, F.lit("' ("), n.cast("string"), F.lit(" words)"))),
        ((kind == "quantitative_measure") & ~text.rlike(r"\d"), F.lit("Quantitative measure missing numeric value")),
        ((kind == "finding") & (n > 4) & ~contains_any(low, vocab.FINDING_WORDS) & low.contains("with"),
         F.lit("Finding classification uncertain - text pattern suggests population description")),
        ((kind == "substance") & low.isin(vocab.GENERIC_WORDS), F.lit("Substance appears too generic")),
        ((kind == "disease") & (low.contains("patient") | low.contains("subject")),
         F.lit("Disease classification contains patient reference")),
    ]
    return _messages(rules)


def _messages(rules: list[tuple[Column, Column]]) -> Column:
    return F.filter(F.array(*[F.when(holds, text) for holds, text in rules]), lambda m: m.isNotNull())


def entity_constraint(text: Column, entity_type: Column, cfg: EntityConfig, found: Column | None = None) -> Column:
    """``found`` are the type violations, where they are already a column. The messages."""
    found = type_violations(text, entity_type) if found is None else found
    bare, kind = strip(text), F.lower(entity_type)
    bad_type = ~kind.isin(vocab.ENTITY_TYPES)
    short, long = F.length(text) < cfg.min_length, F.length(text) > cfg.max_length
    symbol = (F.length(bare) <= 2) & ~bare.rlike(r"^\p{L}+$")
    odd = text.rlike(r"[<>{}|\[\]\\]")
    number = (kind != "quantitative_measure") & text.rlike(r"^[\d.,\-" + vocab.BLANK[1:] + "+$")
    shortness = 1.0 - F.length(bare) / F.lit(cfg.min_length)
    score = _subtract([
        (bad_type, 0.3),
        (short, 0.2 + 0.6 * shortness),
        (long, 0.1),
        (symbol, 0.5),
        (odd, cfg.penalty),
        (number, 0.2),
        (F.lit(True), cfg.penalty * F.size(found)),
    ])
    own = _messages([
        (bad_type, F.concat(F.lit("Invalid entity type: "), entity_type)),
        (short, F.lit(f"Entity text too short (< {cfg.min_length} characters)")),
        (long, F.lit(f"Entity text too long (> {cfg.max_length} characters)")),
        (symbol, F.lit("Entity is a single symbol or punctuation, not a valid medical term")),
        (odd, F.lit("Entity contains invalid characters")),
        (number, F.lit("Non-quantitative entity contains only numbers")),
    ])
    return F.struct(_clamp(score).alias("score"), F.concat(own, found).alias("violations"),
                    (~bad_type).alias("type_valid"), (~(short | long | symbol | odd)).alias("format_valid"))


def entity_completeness(
    text: Column, entity_type: Column, normalized: Column, context: Column, confidence: Column, cfg: EntityConfig
) -> Column:
    """Share of the required fields and of the others, and the names of missing ones."""
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    size = F.length(strip(F.coalesce(text, F.lit(""))))
    status = {
        "type": filled(entity_type), "text": (size > 0) & (size >= cfg.min_length), "context": filled(context),
        "definition": filled(context), "normalized_form": filled(normalized), "confidence": confidence.isNotNull(),
    }
    no = F.lit(False)
    present = lambda names: sum((status.get(n, no).cast("int") for n in names), F.lit(0))
    others = [n for n in status if n not in cfg.required]
    share = lambda names: present(names) / F.lit(len(names)) if names else F.lit(1.0)
    score = share(list(cfg.required)) * F.lit(1.0 - cfg.optional_weight) + share(others) * F.lit(cfg.optional_weight)
    missing = _messages([
        ((size > 0) & (size < cfg.min_length), F.lit("text (too short to be a valid entity)")),
        *[(~status.get(n, no), F.lit(n)) for n in cfg.required],
    ])
    return F.struct(score.alias("score"), missing.alias("missing_fields"), status["type"].alias("has_type"),
                    status["context"].alias("has_context"), status["normalized_form"].alias("has_normalized_form"),
                    status["confidence"].alias("has_confidence"))


def second_model_best(predictions: DataFrame) -> DataFrame:
    """``text, second_type, second_confidence``: the most confident entity per text."""
    best = F.min_by(F.struct("entity_type", "confidence"), F.struct((-F.col("confidence")).alias("c"), "entity_type"))
    return predictions.groupBy("text").agg(best.alias("b")).select(
        "text", F.col("b.entity_type").alias("second_type"), F.col("b.confidence").alias("second_confidence"))


def entity_consistency(
    entity_type: Column, confidence: Column, cfg: EntityConfig, second_type: Column | None = None,
    second_confidence: Column | None = None, failed: Column | None = None,
) -> Column:
    """Confidence, moved by a second model's answer where one was asked (``second_type`` given).

    ``failed`` marks texts for which asking failed.
    """
    base = F.coalesce(confidence, F.lit(cfg.base_score))
    if second_type is None:
        agrees, score = F.lit(None).cast("boolean"), F.least(F.lit(0.8), base)
    else:
        failed = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
        sure = F.coalesce(second_confidence, F.lit(0.0))
        agrees = F.when(~failed, F.lower(second_type) == F.lower(entity_type))
        score = (
            F.when(failed, F.greatest(F.lit(0.0), base - 0.05))
            .when(agrees.isNull(), F.greatest(F.lit(0.0), base - 0.1))
            .when(agrees, F.least(F.lit(1.0), base + cfg.agreement_bonus * sure))
            .otherwise(F.greatest(F.lit(0.0), base - cfg.agreement_bonus * 0.75 * sure))
        )
    other = F.when(~agrees, F.lower(second_type)) if second_type is not None else F.lit(None).cast("string")
    return F.struct(_clamp(score).alias("score"), agrees.alias("agrees"), other.alias("alternate_type"),
                    F.when(agrees.isNotNull(), agrees.cast("double")).alias("cross_validation"))


def entity_decision(overall: Column, congruence: Column, constraint: Column, type_valid: Column, agrees: Column, cfg: EntityConfig) -> Column:
    made = lambda status, advice: F.struct(F.lit(status).alias("review_status"), F.lit(advice).alias("recommendation"))
    review = overall >= cfg.review_at
    return (
        F.when((constraint < 0.4) | ~type_valid, made("failed", "reject"))
        .when(overall >= cfg.pass_at, made("passed", "approve"))
        .when(review & F.coalesce(~agrees, F.lit(False)), made("needs_review", "verify_type"))
        .when(review & (congruence > 0.95), made("needs_review", "check_duplicate"))
        .when(review, made("needs_review", "manual_review"))
        .when(overall < cfg.review_at / 2, made("failed", "reject"))
        .otherwise(made("needs_review", "manual_review"))
    )


ENTITY_INPUTS = ["text", "entity_type", "normalized_text", "context", "confidence"]


def entity_scorecard(
    entities: DataFrame, labels: DataFrame | None = None, second_model: DataFrame | None = None, cfg: EntityConfig = EntityConfig()
) -> DataFrame:
    """All five parts, total, status and advice.

    ``entities(text, entity_type, normalized_text, context, confidence, ...)``; ``labels`` is the
    label table of a graph, or ``entities`` already carry ``kg_matches``. Matches are fetched once
    for the two parts that need them.
    """
    if labels is not None:
        entities = kg_evidence(entities, labels)
    matches = F.col("kg_matches") if "kg_matches" in entities.columns else None
    second: tuple = ()
    if second_model is not None:
        answers = second_model_best(second_model)
        if "failed" in second_model.columns:
            answers = answers.join(second_model.groupBy("text").agg(F.bool_or("failed").alias("second_failed")), "text")
        else:
            answers = answers.withColumn("second_failed", F.lit(False))
        entities = entities.join(answers, "text", "left")
        second = (F.col("second_type"), F.col("second_confidence"), F.col("second_failed"))
    text, kind = F.col("text"), F.col("entity_type")
    scored = entities.withColumn("_found", type_violations(text, kind)).withColumns(
        {
            "congruence": entity_congruence(matches, cfg),
            "coverage": entity_coverage(matches, cfg),
            "constraint": entity_constraint(text, kind, cfg, F.col("_found")),
            "completeness": entity_completeness(text, kind, F.col("normalized_text"), F.col("context"), F.col("confidence"), cfg),
            "consistency": entity_consistency(kind, F.col("confidence"), cfg, *second),
        }
    )
    scored = scored.withColumn("overall_score", _total({p: F.col(p)["score"] for p in PARTS}, cfg.weights))
    decision = entity_decision(F.col("overall_score"), F.col("congruence.score"), F.col("constraint.score"),
                               F.col("constraint.type_valid"), F.col("consistency.agrees"), cfg)
    return scored.withColumn("_d", decision).withColumns(
        {"review_status": F.col("_d.review_status"), "recommendation": F.col("_d.recommendation")}
    ).drop("_d", "_found", "second_type", "second_confidence", "second_failed")


# Relations


def relation_congruence(source_type: Column, relation_type: Column, target_type: Column, cfg: RelationConfig, has_graph: bool = False) -> Column:
    src, rel, tgt = (F.lower(strip(c)) for c in (source_type, relation_type, target_type))
    names = lambda pick: F.element_at(F.create_map(*[
        x for r, pairs in vocab.RELATION_PAIRS.items()
        for x in (F.lit(r), F.array(*[F.lit(v) for v in sorted({pick(p) for p in pairs})]))]), rel)
    has = lambda allowed, value: F.coalesce(F.array_contains(allowed, value), F.lit(False))
    pair = has(names("|".join), F.concat_ws("|", src, tgt))
    a, b = has(names(lambda p: p[0]), src), has(names(lambda p: p[1]), tgt)
    valid = min(1.0, 0.9 + cfg.kg_bonus * 0.5) if has_graph else 0.9
    return (
        F.when(~rel.isin(vocab.RELATION_TYPES), F.lit(max(0.0, 0.5 - cfg.type_penalty)))
        .when(pair, F.lit(valid)).when(a & b, F.lit(0.6)).when(a | b, F.lit(0.4))
        .otherwise(F.lit(max(0.0, 0.3 - cfg.type_penalty)))
    )


def relation_coverage(n_source: Column | None, n_target: Column | None, cfg: RelationConfig) -> Column:
    """From the numbers of matches of both ends; None without a graph."""
    if n_source is None:
        return F.lit(0.7)
    n = F.least(n_source, n_target)
    return _clamp(
        F.when(n == 0, F.lit(0.5 + cfg.novelty_bonus))
        .when(n < cfg.novelty_count, F.lit(0.5 + cfg.novelty_bonus * 0.5))
        .otherwise(F.greatest(F.lit(0.3), 0.6 - 0.1 * n))
    )


def relation_constraint(
    source: Column, source_type: Column, relation_type: Column, target: Column, target_type: Column,
    confidence: Column, context: Column, cfg: RelationConfig,
) -> Column:
    src, rel, tgt = F.lower(source_type), F.lower(relation_type), F.lower(target_type)
    reversed_ = F.lit(False)
    for name, (sources, targets) in vocab.DIRECTIONAL_RELATIONS.items():
        forward = src.isin(sources) & tgt.isin(targets)
        backward = src.isin(targets) & tgt.isin(sources)
        reversed_ = reversed_ | ((rel == name) & ~forward & backward)
    absent = context.isNull() | (context == "")
    return _clamp(_subtract([
        (~rel.isin(vocab.RELATION_TYPES), 0.3),
        (~src.isin(vocab.ENTITY_TYPES), cfg.penalty),
        (~tgt.isin(vocab.ENTITY_TYPES), cfg.penalty),
        (strip(F.lower(source)) == strip(F.lower(target)), 0.3),
        (F.length(strip(source)) < 2, cfg.penalty),
        (F.length(strip(target)) < 2, cfg.penalty),
        (F.coalesce(confidence < cfg.min_confidence, F.lit(False)), cfg.penalty),
        (F.lit(cfg.require_context) & absent, cfg.penalty * 0.5),
        (reversed_, cfg.penalty),
    ]))


def relation_completeness(values: dict[str, Column], cfg: RelationConfig) -> Column:
    """``values`` holds the five relation columns, confidence and context."""
    def filled(name):
        if name not in values:
            return F.lit(False)
        return values[name].isNotNull() if name == "confidence" else F.coalesce(strip(values[name]) != "", F.lit(False))

    def share(names):
        return sum((filled(n).cast("int") for n in names), F.lit(0)) / F.lit(len(names)) if names else F.lit(1.0)

    others = [n for n in values if n not in cfg.required]
    return _clamp(share(list(cfg.required)) * F.lit(1.0 - cfg.optional_weight) + share(others) * F.lit(cfg.optional_weight))


def relation_consistency(source: Column, confidence: Column, cfg: RelationConfig) -> Column:
    base, who = F.coalesce(confidence, F.lit(cfg.base_score)), F.lower(source)
    return _clamp(
        F.when(who == "both", F.least(F.lit(1.0), base + cfg.agreement_bonus))
        .when(who.isin("llm", "bert"), F.least(F.lit(0.85), base)).otherwise(base)
    )


def relation_decision(overall: Column, congruence: Column, constraint: Column, cfg: RelationConfig) -> Column:
    made = lambda status, advice: F.struct(F.lit(status).alias("review_status"), F.lit(advice).alias("recommendation"))
    review = overall >= cfg.review_at
    return (
        F.when((constraint < 0.3) | (congruence < 0.2), made("failed", "reject"))
        .when(overall >= cfg.pass_at, made("passed", "approve"))
        .when(review & (congruence < 0.5), made("needs_review", "verify_type"))
        .when(review, made("needs_review", "manual_review"))
        .otherwise(made("failed", "reject"))
    )


def relation_ends(relations: DataFrame, labels: DataFrame) -> DataFrame:
    """Relations with ``n_source`` and ``n_target``, the numbers of matches (up to five from 0.7 on).

    Each distinct end text is linked once.
    """
    ends = relations.select(F.explode(F.array("source_entity", "target_entity")).alias("text")).distinct().withColumn(
        "q", normalize_text(F.col("text")))
    found = top_k(score_candidates(ends.select("q"), labels, 5, 0.7), ["q"], 5).groupBy("q").agg(F.count(F.lit(1)).cast("int").alias("n"))
    counts = ends.join(found, "q").select("text", "n")
    for side in ("source", "target"):
        one = counts.select(F.col("text").alias(f"{side}_entity"), F.col("n").alias(f"n_{side}"))
        relations = relations.join(one, f"{side}_entity", "left").withColumn(f"n_{side}", F.coalesce(f"n_{side}", F.lit(0)))
    return relations


def relation_scorecard(relations: DataFrame, labels: DataFrame | None = None, cfg: RelationConfig = RelationConfig()) -> DataFrame:
    """All five parts (rounded to 3), total, status and advice. Decisions use the unrounded parts."""
    c = F.col
    graph = labels is not None
    parts = {
        "congruence": relation_congruence(c("source_type"), c("relation_type"), c("target_type"), cfg, graph),
        "constraint": relation_constraint(c("source_entity"), c("source_type"), c("relation_type"), c("target_entity"),
                                          c("target_type"), c("confidence"), c("context"), cfg),
        "completeness": relation_completeness({n: c(n) for n in (*RelationConfig().required, "confidence", "context")}, cfg),
        "consistency": relation_consistency(c("source"), c("confidence"), cfg),
    }
    # Ends are linked behind the parts that need none, so that the joins move the parts and not what they are made of.
    scored = relations.withColumns({f"_{n}": p for n, p in parts.items()})
    if graph:
        scored = relation_ends(scored, labels)
    scored = scored.withColumn("_coverage", relation_coverage(c("n_source") if graph else None, c("n_target") if graph else None, cfg))
    scored = scored.withColumn("overall_score", _total({n: c(f"_{n}") for n in PARTS}, cfg.weights))
    scored = scored.withColumn("_d", relation_decision(c("overall_score"), c("_congruence"), c("_constraint"), cfg))
    return scored.withColumns(
        {
            **{f"{n}_score": round_to(c(f"_{n}"), 3) for n in PARTS},
            "review_status": c("_d.review_status"),
            "recommendation": c("_d.recommendation"),
        }
    ).drop("_d", "n_source", "n_target", *[f"_{n}" for n in PARTS])


def score_explanation(scored: DataFrame, column: str = "explanation") -> DataFrame:
    """``entity_scorecard`` rows with a text that lists the five parts and what weighed on them."""
    percent = lambda c: F.concat(F.format_string("%.2f", round_to(c * 100, 2)), F.lit("%"))
    part = lambda i, name, what, key: F.concat(F.lit(f"{i}. {name} ({what}): "), percent(F.col(key)["score"]))
    said = lambda c: F.when(c, F.lit("True")).otherwise(F.lit("False"))
    nearest, missing, agrees = F.col("congruence.nearest_entity"), F.col("completeness.missing_fields"), F.col("consistency.agrees")
    lines = [
        F.array(F.concat(F.lit("Overall Score: "), percent(F.col("overall_score")), F.lit(" ("), "review_status", F.lit(")")),
                F.concat(F.lit("Recommendation: "), "recommendation"), F.lit(""),
                part(1, "CONGRUENCE", "Semantic Alignment", "congruence")),
        F.when(F.coalesce(nearest, F.lit("")) != "", F.array(F.concat(F.lit("   - Nearest KG entity: "), nearest))),
        F.array(part(2, "COVERAGE", "Representativeness", "coverage"), F.concat(F.lit("   - Is novel: "), said(F.col("coverage.is_novel"))),
                F.concat(F.lit("   - Similar entities in KG: "), F.col("coverage.similar_count").cast("string")),
                part(3, "CONSTRAINT", "Clinical Validity", "constraint")),
        F.transform("constraint.violations", lambda v: F.concat(F.lit("   ⚠ "), v)),
        F.array(part(4, "COMPLETENESS", "Required Attributes", "completeness")),
        F.when(F.size(missing) > 0, F.array(F.concat(F.lit("   - Missing: "), F.array_join(missing, ", ")))),
        F.array(part(5, "CONSISTENCY", "Type Coherence", "consistency")),
        F.when(agrees.isNotNull(), F.array(F.concat(F.lit("   - BERT agreement: "), F.when(agrees, F.lit("✓")).otherwise(F.lit("✗"))))),
    ]
    none = F.array().cast("array<string>")
    return scored.withColumn(column, F.array_join(F.concat(*[F.coalesce(x, none) for x in lines]), "\n"))
