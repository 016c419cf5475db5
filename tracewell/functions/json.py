"""JSON pointers and strict JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_pointer(pointer: Column) -> Column:
    """Whether a fragment pointer is well formed: ``#`` and steps that begin with a slash, tildes only as ~0 or ~1."""
    return pointer.rlike(r"^#(?:/(?:~[01]|[^/~])*)*$")


def _steps(pointer: str) -> list[str]:
    return [s.replace("~1", "/").replace("~0", "~") for s in unquote(pointer[1:]).split("/")[1:]]


def _follow(document: object, pointer: str) -> object:
    for step in _steps(pointer):
        if isinstance(document, list):
            if not step.isascii() or not step.isdigit() or (step[0] == "0" and step != "0"):
                raise KeyError(step)
            document = document[int(step)]
        elif isinstance(document, dict):
            document = document[step]
        else:
            raise KeyError(step)
    return document


def _unique(members: list) -> dict:
    out = dict(members)
    if len(out) != len(members):
        raise ValueError("a key repeats")
    return out


def _refuse(name: str) -> None:
    raise ValueError(name)


def load(text: str) -> object:
    """JSON without repeated keys, NaN and infinities."""
    return json.loads(text, object_pairs_hook=_unique, parse_constant=_refuse)


def _compact(value: object) -> str:
    return json.JSONEncoder(sort_keys=True, separators=tuple(",:"), ensure_ascii=False).encode(value)


def _resolve(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for documents, pointers in columns:
        out = []
        for text, pointer in zip(documents.to_pylist(), pointers.to_pylist()):
            try:
                out.append(_compact(_follow(load(text), pointer)))
            except (KeyError, IndexError, ValueError, TypeError, AttributeError):
                out.append(None)
        yield pa.array(out, pa.string())


def resolve(document: Column, pointer: Column) -> Column:
    """The JSON at a pointer (RFC 6901, as a fragment), or null if it dangles or either is malformed."""
    return F.when(is_pointer(pointer), F.arrow_udf(_resolve, "string")(document, pointer))


def strict(document: Column) -> Column:
    """Whether a text is JSON without repeated keys."""
    return F.try_parse_json(document).isNotNull()


#: Names of fields that could hold a source's text a second time (JSON-4).
COPY_FIELDS = tuple(sorted({"body", "content", "embedding", "excerpt", "quote", "text"} | {f"{kind}_text" for kind in ("normalized", "source")}))


def copies_text(raw: Column) -> Column:
    """Whether a JSON text has, at any depth, a field that could hold source text; null if it is no JSON."""
    names = "|".join(COPY_FIELDS)
    # Strings are taken whole, so that no quote inside one counts; those before a colon are names and stay.
    text = r'"(?:[^"\\]|\\.)*+"'
    bare = F.regexp_replace(raw, rf"({text}\s*+:)|{text}", "$1")
    return F.when(F.try_parse_json(raw).isNotNull(), bare.rlike(rf'"(?:{names})"\s*:'))


def _canonical(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        out = []
        for raw in batch.to_pylist():
            try:
                out.append(None if raw is None else _compact(load(raw)))
            except (ValueError, RecursionError):
                out.append(None)
        yield pa.array(out, pa.string())


def canonical(raw: Column) -> Column:
    """A JSON text in its one canonical form: keys in order, no blanks, signs as they are; null for what :func:`strict` refuses."""
    return F.arrow_udf(_canonical, "string")(raw)


def canonical_hash(raw: Column) -> Column:
    """The SHA-256 of the canonical form."""
    return F.sha2(canonical(raw), 256)
