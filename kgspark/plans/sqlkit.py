"""Pieces of SQL that several checks share."""

from __future__ import annotations


def names(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def array(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def mapping(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


def normalized(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"


def local_name(x: str) -> str:
    return f"regexp_extract({x}, '[^/#]*$')"
