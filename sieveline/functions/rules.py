"""Validation as data: each broken rule becomes one row, nothing is dropped silently."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ValidationError(ValueError):
    """Raised in strict mode when a violations table is not empty."""


def violations(
    df: DataFrame,
    location: Column,
    rules: Iterable[tuple[str, Column, Column]],
) -> DataFrame:
    """One row (location, rule, detail) per rule whose condition is true or cannot be told.

    Every rule is checked in a single pass over ``df``. A null condition counts as broken: a rule
    that does not apply to a row has to say so itself.
    """
    return df.select(location.cast("string").alias("location"), F.explode(broken(rules)).alias("v")).select(
        "location", "v.rule", "v.detail"
    )


def broken(rules: Iterable[tuple[str, Column, Column]]) -> Column:
    """(rule, detail) of every rule whose condition is true or cannot be told, as one array."""
    checks = [
        F.when(F.coalesce(condition, F.lit(True)), F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail")))
        for name, condition, detail in rules
    ]
    return F.array_compact(F.array(*checks))


def require_none(found: DataFrame) -> None:
    """Fail closed: raise on the first violations, quoting a few of them."""
    rows = found.take(5)
    if rows:
        raise ValidationError("; ".join(f"{r.location}: {r.rule} ({r.detail})" for r in rows))


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def is_int(value: object) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def not_unit(value: Column) -> Column:
    """True for a feature that is missing, not finite, or outside [0, 1]."""
    return value.isNull() | F.isnan(value) | (value < 0) | (value > 1)


def not_finite(value: Column) -> Column:
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
