"""Column functions on URIs, entity types and token labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from kgspark import vocab
from kgspark.functions.text import contains_any


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(pairs.items())])


def lookup(pairs: dict[str, str], c: Column) -> Column:
    """Value of a fixed map, null when the key is missing."""
    return F.element_at(literal_map(pairs), c)


def _after_last(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, -1)


def local_name(uri: Column) -> Column:
    """What follows the last "#", and of that what follows the last "/"."""
    return _after_last(_after_last(uri, "#"), "/")


def local_name_slash_first(uri: Column) -> Column:
    return _after_last(_after_last(uri, "/"), "#")


def shorten_uri(uri: Column) -> Column:
    out = None
    for prefix in vocab.DISPLAY_PREFIXES:
        full = vocab.PREFIXES[prefix]
        short = F.concat(F.lit(prefix + ":"), F.substring(uri, F.lit(len(full) + 1), F.length(uri)))
        out = F.when(uri.startswith(full), short) if out is None else out.when(uri.startswith(full), short)
    tail = F.regexp_extract(uri, r"(?s)[#/][^#/]*$", 0)
    return out.when(tail != "", F.concat(F.lit("..."), tail)).otherwise(uri)


def expand_curie(name: Column) -> Column:
    """prefix:name to a full URI for the common prefixes; anything else is unchanged."""
    prefix = F.lower(F.substring_index(name, ":", 1))
    base = lookup(vocab.PREFIXES, prefix)
    rest = F.regexp_extract(name, r"^[^:]*:(\w.*)$", 1)
    return F.when((rest != "") & base.isNotNull(), F.concat(base, rest)).otherwise(name)


def canonical_kg_type(local: Column) -> Column:
    """Canonical entity type of a class name, null when it is not one."""
    return lookup(vocab.CANONICAL_KG_TYPES, F.lower(local))


def map_foreign_label(label: Column) -> Column:
    bare = F.regexp_replace(F.lower(label), "[_-]", "")
    return F.coalesce(
        lookup(vocab.FOREIGN_LABELS, bare),
        F.when(F.lower(label).isin(vocab.ENTITY_TYPES), F.lower(label)),
        F.lit(vocab.DEFAULT_ENTITY_TYPE),
    )


def normalize_iob_label(label: Column) -> Column:
    side = F.upper(F.substring(label, 1, 2))
    rest = F.substring(label, F.lit(3), F.length(label))
    snake = F.lower(F.regexp_replace(rest, "(?<!^)(?=[A-Z])", "_"))
    return (
        F.when(F.lower(label) == "o", F.lit("O"))
        .when(side.isin("B-", "I-"), F.concat(side, F.coalesce(lookup(vocab.IOB_SYNONYMS, snake), snake)))
        .otherwise(label)
    )


def format_iob_type(entity_type: Column) -> Column:
    capital = F.concat(
        F.upper(F.substring(entity_type, 1, 1)),
        F.lower(F.substring(entity_type, F.lit(2), F.length(entity_type))),
    )
    return F.coalesce(lookup(vocab.CLASS_NAMES, F.lower(entity_type)), capital)


def label_id(label: Column) -> Column:
    """Position in the token-label vocabulary; unknown labels get 0."""
    at = F.array_position(F.array(*[F.lit(x) for x in vocab.TOKEN_LABELS]), label)
    return F.greatest(at - 1, F.lit(0)).cast("int")


def id_label(i: Column) -> Column:
    names = F.array(*[F.lit(x) for x in vocab.TOKEN_LABELS])
    return F.coalesce(F.get(names, i), F.lit("O"))


def infer_entity_type(text: Column) -> Column:
    low = F.lower(text)
    first, *others = vocab.TYPE_HINTS
    out = F.when(contains_any(low, first[1]), F.lit(first[0]))
    for name, words in others:
        out = out.when(contains_any(low, words), F.lit(name))
    return out.otherwise(F.lit(vocab.DEFAULT_ENTITY_TYPE))


def mint_uri(text: Column, stamp_ms: int, entity_type: Column | None = None) -> Column:
    """A new URI for a text, or for a text of a type.

    The run's time stamp is an argument, so a rerun mints the same URI; the hash of type and full text keeps apart
    what is equal once unsafe characters are replaced.
    """
    safe = F.regexp_replace(text, "[^a-zA-Z0-9]", "_")
    kind = F.lit("") if entity_type is None else F.coalesce(entity_type, F.lit(""))
    own = F.substring(F.md5(F.concat(kind, F.lit("|"), text).cast("binary")), 1, 12)
    return F.concat(F.lit(vocab.BASE), safe, F.lit(f"_{stamp_ms}_"), own)


def link_predicate(link_type: Column) -> Column:
    return F.coalesce(lookup(vocab.LINK_PREDICATES, link_type), F.lit(vocab.DEFAULT_LINK_PREDICATE))


def allowed_kg_types(entity_type: Column) -> Column:
    """Classes a type may link to; null means that every class fits."""
    pairs = [(F.lit(k), F.array(*[F.lit(x) for x in v])) for k, v in vocab.ALLOWED_KG_TYPES.items()]
    return F.element_at(F.create_map(*chain.from_iterable(pairs)), entity_type)


def type_compatible(type_names: Column, entity_type: Column) -> Column:
    """type_names holds the local names of an entity's classes."""
    allowed = allowed_kg_types(entity_type)
    return allowed.isNull() | F.coalesce(F.arrays_overlap(type_names, allowed), F.lit(False))


def class_name(entity_type: Column) -> Column:
    return F.coalesce(lookup(vocab.CLASS_NAMES, F.lower(entity_type)), F.lit("Finding"))
