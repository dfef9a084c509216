"""X1 operator registry and X2 metric registry.

X1: a registered query is ``fn(spark, sf_dir) -> DataFrame`` plus, where the
semantics are SQL-expressible, a DuckDB twin used as the correctness
oracle.  ``tool_subset`` / categories mirror how tools are grouped.

X2: a metric is a named list of aggregate ``Column``s over the step table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession


@dataclass
class Registered:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    category: str = "general"
    doc: str = ""


_QUERIES: dict[str, Registered] = {}


def query(name: str, sql: str | None = None, category: str = "general"):
    """Decorator: register ``fn(spark, sf_dir)`` under ``name``."""
    def deco(fn):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = Registered(name, fn, sql.strip() if sql else None, category, (fn.__doc__ or "").strip())
        return fn
    return deco


def _load_all():
    # importing the plan modules registers their queries
    from quarry.plans import (q_search, q_cells, q_traces, q_metrics, q_messages, q_samples,  # noqa: F401
                              q_cache, q_retrieval, q_streaming, q_sources)


def registered() -> dict[str, Registered]:
    _load_all()
    return dict(_QUERIES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v.fn for k, v in registered().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v.sql for k, v in registered().items() if v.sql}


def categories() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for r in registered().values():
        out.setdefault(r.category, []).append(r.name)
    return out


# ------------------------------------------------------------------ X2
@dataclass
class Metric:
    name: str
    columns: Callable[[], list[Column]]
    group_by: list[str] = field(default_factory=list)


_METRICS: dict[str, Metric] = {}


def register_metric(name: str, group_by: list[str] | None = None):
    def deco(fn):
        _METRICS[name] = Metric(name, fn, group_by or [])
        return fn
    return deco


def create_metric(name: str) -> Metric:
    if name not in _METRICS:
        raise KeyError(f"unknown metric {name}; known: {sorted(_METRICS)}")
    return _METRICS[name]


def evaluate_metrics(steps: DataFrame, names: list[str]) -> DataFrame:
    """Run several registered metrics as ONE aggregate over ``steps``."""
    cols: list[Column] = []
    for n in names:
        cols.extend(create_metric(n).columns())
    return steps.agg(*cols)
