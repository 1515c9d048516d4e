"""Threshold scores, deviation rules and logistic links as reusable expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Band:
    """points if test holds; test is 'op bound' with op one of < <= > >=."""

    op: str
    bound: float
    points: float


def banded(value: Column, bands: Sequence[Band], normal: float | None = 0) -> Column:
    """Points of the first band that holds, else normal; null for a null value."""
    tests = {"<": lambda b: value < b, "<=": lambda b: value <= b, ">": lambda b: value > b, ">=": lambda b: value >= b}
    out = F.lit(normal)
    for band in reversed(bands):
        out = F.when(tests[band.op](band.bound), F.lit(band.points)).otherwise(out)
    return F.when(value.isNotNull(), out)


def worst_from_normal(low: Column, high: Column, normal: float) -> Column:
    """Of a minimum and a maximum the one farther from normal (the maximum on a tie)."""
    return F.when(F.abs(high - normal) >= F.abs(low - normal), high).when(F.abs(high - normal) < F.abs(low - normal), low).otherwise(F.coalesce(high, low))


def total(*parts: Column) -> Column:
    """Sum that counts nulls as 0."""
    out = F.lit(0)
    for part in parts:
        out = out + F.coalesce(part, F.lit(0))
    return out


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
