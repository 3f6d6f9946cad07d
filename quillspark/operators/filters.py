"""Filters over metadata given as nested dictionaries, compiled to columns, so that they reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

_COMPARE = {"$eq": "__eq__", "$ne": "__ne__", "$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}


def compile_filter(where: dict, allowed: set[str]) -> Column:
    """One key at each level: a column with a value or one operator, or $and / $or over a list.

    A column that is null matches nothing, not even $ne or $nin. Unknown columns or operators, empty lists and more
    than one key raise ValueError.
    """
    if not isinstance(where, dict) or len(where) != 1:
        raise ValueError("a filter has exactly one key")
    ((key, value),) = where.items()
    if key in ("$and", "$or"):
        if not isinstance(value, list) or not value:
            raise ValueError(f"{key} needs a list")
        parts = [compile_filter(v, allowed) for v in value]
        return reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), parts)
    if key not in allowed:
        raise ValueError(f"unknown column {key}")
    operator, operand = next(iter(value.items())) if isinstance(value, dict) and len(value) == 1 else ("$eq", value)
    if isinstance(operand, dict):
        raise ValueError("one operator for a column")
    c = F.col(key)
    if operator in ("$in", "$nin"):
        if not operand:
            raise ValueError(f"{operator} needs values")
        hit = c.isin(list(operand))
        return c.isNotNull() & (hit if operator == "$in" else ~hit)
    if operator not in _COMPARE:
        raise ValueError(f"unknown operator {operator}")
    return c.isNotNull() & getattr(c, _COMPARE[operator])(operand)
