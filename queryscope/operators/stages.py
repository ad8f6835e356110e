"""Aggregation stages: ``$match``, ``$group``, ``$project``, ``$sort`` and ``$limit``."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TESTS = {
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$exists": lambda c, v: c.isNotNull() if v else c.isNull(),
}


def match(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    """All conditions must hold; a condition is a value or ``{"$op": value}``."""
    tests: list[Column] = []
    for name, want in spec.items():
        if isinstance(want, Mapping):
            for op, value in want.items():
                if op not in _TESTS:
                    raise ValueError(f"unsupported predicate {op!r}")
                tests.append(_TESTS[op](F.col(name), value))
        else:
            tests.append(F.col(name) == want)
    return df.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def _aggregate(spec: Mapping[str, Any]) -> Column:
    ((op, arg),) = spec.items()
    if op == "$sum" and arg == 1:
        return F.count(F.lit(1))  # counts every row, also for COUNT(col)
    if not (isinstance(arg, str) and arg.startswith("$")):
        raise ValueError(f"unsupported aggregate {spec!r}")
    source = F.col(arg[1:])
    aggs = {"$sum": F.sum, "$avg": F.avg, "$min": F.min, "$max": F.max}
    if op not in aggs:
        raise ValueError(f"unsupported aggregate {op!r}")
    return aggs[op](source)


def default_name(func: str, column: str | None) -> str:
    return "count" if column is None else f"{func.lower()}_{column}"


def group(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    """``_id`` is None for one global group, or ``{name: "$column"}``; the rest are aggregates."""
    keys = spec.get("_id") or {}
    aggs = [_aggregate(v).alias(k) for k, v in spec.items() if k != "_id"]
    out = df.groupBy(*[F.col(v[1:]).alias(k) for k, v in keys.items()]).agg(*aggs)
    names = [k for k in spec if k != "_id"]
    return out.select(F.struct(*keys).alias("_id"), *names) if keys else out


def project(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    """``name: 1`` keeps a column, ``name: "$path"`` renames or flattens one, 0 leaves it out."""
    return df.select(*[F.col(k) if v == 1 else F.col(v[1:]).alias(k) for k, v in spec.items() if v])


def sort(df: DataFrame, spec: Mapping[str, int]) -> DataFrame:
    """1 ascending with nulls first, -1 descending with nulls last."""
    return df.orderBy(*[F.asc_nulls_first(k) if v == 1 else F.desc_nulls_last(k) for k, v in spec.items()])


def run_stages(df: DataFrame, stages: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Apply the stages in order; Catalyst plans them as one query."""
    steps = {"$match": match, "$group": group, "$project": project, "$sort": sort, "$limit": lambda d, n: d.limit(n)}
    for stage in stages:
        ((name, spec),) = stage.items()
        if name not in steps:
            raise ValueError(f"unsupported stage {name!r}")
        df = steps[name](df, spec)
    return df
