"""Time-series operators: windows, interval and as-of joins, grids, sessions and segments.

Columns are arguments, so they bind to any schema; times are TIMESTAMP_NTZ or numbers (minutes since admission).
Every join keeps its equality key. Where a key may have very many rows, bins of time are part of it (binned_interval_join, window_join), so
the rows of one key are spread over tasks and only rows of neighbouring times are compared; the time condition itself is a residual of the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, TimestampType
from pyspark.sql.window import Window

CLOSED = ("both", "left", "right")


def micros(time: Column) -> Column:
    """A timestamp as whole microseconds, which range frames can be counted in."""
    return F.unix_micros(time.cast(TimestampType()))  # the name "timestamp" would follow spark.sql.timestampType


def within(time: Column, low: Column, high: Column, closed: str) -> Column:
    """Containment; closed says which ends belong: both, left or right. There is no default, as all three are in use."""
    if closed not in CLOSED:
        raise ValueError(f"closed must be one of {CLOSED}")
    above = time >= low if closed in ("both", "left") else time > low
    below = time <= high if closed in ("both", "right") else time < high
    return above & below


def interval_join(points: DataFrame, intervals: DataFrame, key: str | list[str], time: str, low: str, high: str, closed: str, how: str = "left") -> DataFrame:
    """Points with the intervals of their key that hold them. The other columns of the two sides must not clash."""
    keys = [key] if isinstance(key, str) else key
    right = intervals.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in intervals.columns if c not in keys])
    on = within(F.col(time), F.col(low), F.col(high), closed)
    for k in keys:
        on = (F.col(k) == F.col(f"_{k}")) & on
    return points.join(right, on, how).drop(*[f"_{k}" for k in keys])


#: A day in microseconds, a width of bins for stays and infusions.
DAY = 86_400_000_000
#: Bins that one interval is laid into at most.
MOST_BINS = 1 << 16


def _ticks(df: DataFrame, name: str) -> Column:
    """A time as a whole number that keeps the order: microseconds of a timestamp or date, the floor of a number."""
    kind = df.schema[name].dataType
    return F.floor(F.col(name)).cast("long") if isinstance(kind, NumericType) else micros(F.col(name))


def _bin(ticks: Column, width: int) -> Column:
    return ((ticks - F.pmod(ticks, F.lit(width))) / width).cast("long")  # a whole quotient, exact as a double below 2^53


def bin_width(intervals: DataFrame, low: str, high: str) -> int:
    """The mean length of the intervals, so that all of them together fill at most three bins each, or more if the longest would fill over MOST_BINS."""
    length = _ticks(intervals, high) - _ticks(intervals, low)
    mean, most = intervals.where(F.col(low) <= F.col(high)).agg(F.avg(length), F.max(length)).first()
    return max(1, int(mean or 1), -(-int(most or 0) // MOST_BINS))


def binned_interval_join(
    points: DataFrame, intervals: DataFrame, key: str | list[str], time: str, low: str, high: str, closed: str, how: str = "left", width: int | None = None
) -> DataFrame:
    """interval_join with bins of time in its key, for keys of very many points or intervals; how is "left" or "inner".

    A point lies in one bin, an interval is laid into every bin that it touches, so a pair meets once, and a key's rows are spread over its bins. width: of a bin, in microseconds or units of a number; by default
    it is chosen from the lengths of the intervals, which takes a pass over them. Null times and null keys match nothing.
    """
    keys = [key] if isinstance(key, str) else key
    width = width or bin_width(intervals, low, high)
    right = intervals.where(F.col(low) <= F.col(high))
    bins = F.sequence(_bin(_ticks(intervals, low), width), _bin(_ticks(intervals, high), width))
    right = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in intervals.columns if c not in keys], F.explode(bins).alias("_bin_r"))
    on = (F.col("_bin_l") == F.col("_bin_r")) & within(F.col(time), F.col(low), F.col(high), closed)
    for k in keys:
        on = (F.col(k) == F.col(f"_{k}")) & on
    return points.withColumn("_bin_l", _bin(_ticks(points, time), width)).join(right, on, how).drop(*[f"_{k}" for k in keys], "_bin_l", "_bin_r")


def overlaps(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    return (low_a <= high_b) & (low_b <= high_a)


def overlap_join(first: DataFrame, second: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str], width: int | None = None) -> DataFrame:
    """Pairs of intervals of one key that share an instant, ends included. Both sides are laid into bins, and a pair counts in the first bin that both touch. Columns must not clash."""
    width = width or max(bin_width(first, *a), bin_width(second, *b))

    def laid(df: DataFrame, ends: tuple[str, str], side: str, named: str) -> DataFrame:
        low, high = (_bin(_ticks(df, x), width) for x in ends)
        return df.where(F.col(ends[0]) <= F.col(ends[1])).withColumns({f"_low_{side}": low, f"_bin_{side}": F.explode(F.sequence(low, high))}).withColumnRenamed(key, named)

    left, right = laid(first, a, "l", key), laid(second, b, "r", "_key")
    on = (F.col(key) == F.col("_key")) & (F.col("_bin_l") == F.col("_bin_r")) & (F.col("_bin_l") == F.greatest("_low_l", "_low_r"))
    return left.join(right, on & overlaps(F.col(a[0]), F.col(a[1]), F.col(b[0]), F.col(b[1]))).drop("_key", "_low_l", "_low_r", "_bin_l", "_bin_r")


def _span(df: DataFrame, *parts: str) -> int:
    """Microseconds that the intervals last together at most; months and years last up to a tenth longer than from the start of 2000 on."""
    base = "TIMESTAMP_NTZ'2000-01-01'"
    total = sum(df.sparkSession.sql(f"SELECT timestampdiff(MICROSECOND, {base}, {base} + INTERVAL {p}) AS n").first()["n"] for p in parts)
    return max(1, int(total * 1.1))


def window_join(left: DataFrame, points: DataFrame, key: str, time: str, low: str, high: str, closed: str, span: int, how: str = "left") -> DataFrame:
    """Rows of left with the points of their key from low to high, windows of at most span microseconds.

    A window lies in the bin where it begins, a point in its own bin and the one before, so a pair meets once and rows of left without a point keep one row (how = "left").
    The columns of the two sides must not clash but for the key.
    """
    right = points.withColumn("_bin_r", F.explode(F.array(_bin(_ticks(points, time), span), _bin(_ticks(points, time), span) - 1))).withColumnRenamed(key, "_key")
    on = (F.col(key) == F.col("_key")) & (F.col("_bin_l") == F.col("_bin_r")) & within(F.col(time), F.col(low), F.col(high), closed)
    return left.withColumn("_bin_l", _bin(_ticks(left, low), span)).join(right, on, how).drop("_key", "_bin_l", "_bin_r")


def anchored_window(events: DataFrame, anchors: DataFrame, key: str, time: str, anchor: str, before: str, after: str, aggregates: list[Column], closed: str = "both") -> DataFrame:
    """Aggregates of each anchor's events from anchor - before to anchor + after; anchors without events keep a row."""
    columns = anchors.columns
    low, high = F.col(anchor) - F.expr(f"INTERVAL {before}"), F.col(anchor) + F.expr(f"INTERVAL {after}")
    windows, near = anchors.withColumns({"_low": low, "_high": high}), events.withColumnRenamed(time, "_time").drop(anchor)
    return window_join(windows, near, key, "_time", "_low", "_high", closed, _span(anchors, before, after)).groupBy(*columns).agg(*aggregates)


def rolling(df: DataFrame, key: str | list[str], time: str, span_seconds: int, aggregates: dict[str, Column], include_current: bool = True) -> DataFrame:
    """Aggregates over the rows of the last span_seconds, by a range frame; ties at one instant share their frame."""
    keys = [key] if isinstance(key, str) else key
    frame = Window.partitionBy(*keys).orderBy(micros(F.col(time))).rangeBetween(-span_seconds * 1_000_000, 0 if include_current else -1)
    return df.withColumns({name: agg.over(frame) for name, agg in aggregates.items()})


def rolling_rows(df: DataFrame, key: str, order: list[str], rows: int, aggregates: dict[str, Column]) -> DataFrame:
    frame = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - rows, 0)
    return df.withColumns({name: agg.over(frame) for name, agg in aggregates.items()})


def asof_latest(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within_seconds: int, values: list[str], tie: str) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before it, no older than within_seconds.

    Both sides are laid along one time line and the last right row is carried forward, so a key's rows are sorted once and
    no pairs are made. Among right rows of one instant the one with the largest tie counts.
    """
    carried, held = F.struct(F.col(right_time).alias("at"), *values), F.struct(*[c for c in left.columns if c != key])  # the key once, so sides that are dealt by it stay where they are
    marks = right.select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(tie).cast("string").alias("_tie"), F.col(tie).alias("_tie_order"), carried.alias("_r"), F.lit(None).cast(left.select(held).schema[0].dataType).alias("_l"))
    rows = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_tie"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie_order"), F.lit(None).cast(right.select(carried).schema[0].dataType).alias("_r"), held.alias("_l"))
    line = Window.partitionBy("_k").orderBy("_t", "_side", F.col("_tie_order").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    joined = marks.unionByName(rows).withColumn("_last", F.last("_r", ignorenulls=True).over(line)).where("_side = 1")
    fresh = F.col("_last.at") >= F.col("_t") - F.make_dt_interval(secs=F.lit(within_seconds))
    kept = [F.col("_k").alias(c) if c == key else F.col(f"_l.`{c}`") for c in left.columns]
    return joined.select(*kept, *[F.when(fresh, F.col(f"_last.{v}")).alias(v) for v in values], F.when(fresh, F.col("_last.at")).alias(f"{right_time}_matched"))


def previous_within(df: DataFrame, key: str, order: list[str], time: str, value: str, limit_seconds: int, out: str) -> DataFrame:
    """The value of the row before, where that row is less than limit_seconds older."""
    line = Window.partitionBy(key).orderBy(*order)
    recent = F.lag(time).over(line) > F.col(time) - F.make_dt_interval(secs=F.lit(limit_seconds))
    return df.withColumn(out, F.when(recent, F.lag(value).over(line)))


def hourly_grid(stays: DataFrame, key: str, start: str, end: str, lead_hours: int = 24) -> DataFrame:
    """key, hr, endtime: hours from -lead_hours to the stay's length; hour 0 ends at the first full hour at or after start."""
    top = F.date_trunc("hour", F.col(start)).cast("timestamp_ntz")
    first = F.when(top == F.col(start), top).otherwise(top + F.expr("INTERVAL 1 HOUR"))
    last = F.ceil(F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)) / 3.6e9).cast("int")
    hours = F.when(last >= -lead_hours, F.sequence(F.lit(-lead_hours), last)).otherwise(F.array().cast("array<int>"))
    grid = stays.select(key, first.alias("_first"), F.explode(hours).alias("hr"))
    return grid.select(key, "hr", (F.col("_first") + F.make_dt_interval(hours=F.col("hr"))).alias("endtime"))


def close_with_lead(df: DataFrame, key: str, order: list[str], start: str, default_end: Column, out: str = "endtime") -> DataFrame:
    """Intervals from points: each ends where the next one of its key begins, the last at default_end."""
    return df.withColumn(out, F.coalesce(F.lead(start).over(Window.partitionBy(key).orderBy(*order)), default_end))


def sessions(df: DataFrame, key: str, order: list[str], time: str, status: str, gap_seconds: int, least_rows: int = 2) -> DataFrame:
    """key, status, session, starttime, endtime, rows: runs of one status without a gap of gap_seconds or more within the status; runs of
    fewer than least_rows rows go."""
    line, same = Window.partitionBy(key).orderBy(*order), Window.partitionBy(key, status).orderBy(*order)
    gap = F.timestamp_diff("MICROSECOND", F.lag(time).over(same), F.col(time)) >= gap_seconds * 1_000_000
    before = F.lag(status).over(line)
    new = before.isNull() | gap | (before != F.col(status))
    marked = df.withColumn("_new", F.when(new, 1).otherwise(0))
    marked = marked.withColumn("session", F.sum("_new").over(line))
    runs = marked.groupBy(key, status, "session").agg(F.min(time).alias("starttime"), F.max(time).alias("endtime"), F.count("*").alias("rows"))
    return runs.where(F.col("rows") >= least_rows)


def segments(intervals: list[DataFrame], key: str, start: str, end: str) -> DataFrame:
    """key, starttime, endtime: the time line of a key cut at every start and end of its intervals."""
    points = None
    for df in intervals:
        both = df.select(key, F.col(start).alias("starttime")).unionByName(df.select(key, F.col(end).alias("starttime")))
        points = both if points is None else points.unionByName(both)
    line = Window.partitionBy(key).orderBy("starttime")
    return points.where("starttime is not null").distinct().withColumn("endtime", F.lead("starttime").over(line)).where("endtime is not null")


def event_pairs(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, before: str, after: str) -> DataFrame:
    """Pairs of one key where the right event lies from `before` ahead of the left one to `after` behind it."""
    windows = left.withColumns({"_low": F.col(left_time) - F.expr(f"INTERVAL {before}"), "_high": F.col(left_time) + F.expr(f"INTERVAL {after}")})
    return window_join(windows, right, key, right_time, "_low", "_high", "both", _span(left, before, after), how="inner").drop("_low", "_high")
