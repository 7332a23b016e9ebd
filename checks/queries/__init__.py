"""Spark side of every registered query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from trustlens.sources.samples import SampleTables

Query = Callable[[SampleTables], DataFrame]


def registered() -> dict[str, Query]:
    from checks.queries import aggregates, catalogue, points, rescoring, scores, sources, streams, text

    out: dict[str, Query] = {}
    for module in (sources, aggregates, points, scores, catalogue, text, rescoring, streams):
        for name, query in module.QUERIES.items():
            if name in out:
                raise ValueError(f"duplicate query {name}")
            out[name] = query
    return out
