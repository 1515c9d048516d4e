"""Conditional-aggregation pivots with plausibility guards: one pass over the events, whatever the number of columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Item:
    """An output column: the items it reads, its guard low < value < high (an end may belong, or be open), and a factor."""

    name: str
    items: tuple
    low: float | None = None
    high: float | None = None
    low_in: bool = False
    high_in: bool = True
    agg: str = "max"
    text: bool = False


def guarded(item: Item, code: Column, value: Column) -> Column:
    keep = code.isin(*item.items)
    if item.low is not None:
        keep = keep & (value >= item.low if item.low_in else value > item.low)
    if item.high is not None:
        keep = keep & (value <= item.high if item.high_in else value < item.high)
    return F.when(keep, value)


AGGREGATES = {"max": F.max, "min": F.min, "avg": F.avg, "sum": F.sum}


def guarded_pivot(events: DataFrame, by: list[str], code: str, value: str, items: list[Item], text: str | None = None, largest: tuple[str, ...] = ()) -> DataFrame:
    """One row per group that has at least one of the items; the filter on codes reaches the scan. largest: columns of which the maximum comes first."""
    wanted = sorted({x for item in items for x in item.items})
    columns = [AGGREGATES[i.agg](guarded(i, F.col(code), F.col(text if i.text and text else value))).alias(i.name) for i in items]
    return events.where(F.col(code).isin(*wanted)).groupBy(*by).agg(*[F.max(c).alias(c) for c in largest], *columns)
