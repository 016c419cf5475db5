"""Plain rendering of values for people: keys and values indented, lists of records as tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Mapping


def _cell(value: object) -> str:
    if value is None:
        return "-"
    if isinstance(value, bool):
        return "yes" if value else "no"
    return str(value)


def _table(rows: Sequence[Mapping], pad: str) -> list[str]:
    names = list(dict.fromkeys(k for r in rows for k in r))
    cells = [names, *[[_cell(r.get(n)) for n in names] for r in rows]]
    width = [max(len(line[i]) for line in cells) for i in range(len(names))]
    return [pad + "  ".join(c.ljust(w) for c, w in zip(line, width)).rstrip() for line in cells]


def render(value: object, indent: int = 0) -> str:
    """Text for a value made of mappings, sequences and scalars."""
    pad = "  " * indent
    if isinstance(value, Mapping):
        lines = []
        for key, item in value.items():
            nested = isinstance(item, (Mapping, Sequence)) and not isinstance(item, str) and item
            lines.append(f"{pad}{key}:" + ("" if nested else f" {'-' if item in ([], (), {}) else _cell(item)}"))
            if nested:
                lines.append(render(item, indent + 1))
        return "\n".join(lines)
    if isinstance(value, Sequence) and not isinstance(value, str):
        if value and all(isinstance(v, Mapping) for v in value):
            return "\n".join(_table(value, pad))
        return "\n".join(render(v, indent) for v in value)
    return pad + _cell(value)
