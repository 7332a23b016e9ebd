"""Oracle SQL: one statement per query, put together from shared views."""

from __future__ import annotations

import re

from checks.oracle.views import VIEWS


def _needed(sql: str, seen: list[str]) -> None:
    """Append the views a statement mentions, dependencies first."""
    for name in VIEWS:
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needed(VIEWS[name], seen)
            if name not in seen:
                seen.append(name)


def statement(sql: str) -> str:
    """Prefix a SELECT with the views it needs."""
    names: list[str] = []
    _needed(sql, names)
    if not names:
        return sql
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in names)
    return f"WITH {views}\n{sql}"


def statements() -> dict[str, str]:
    from checks.oracle import aggregates, catalogue, points, rescoring, scores, sources, streams, text

    out: dict[str, str] = {}
    for module in (sources, aggregates, points, scores, catalogue, text, rescoring, streams):
        for name, sql in module.SQL.items():
            if name in out:
                raise ValueError(f"duplicate oracle {name}")
            out[name] = statement(sql)
    return out
