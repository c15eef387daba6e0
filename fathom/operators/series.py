"""Operators on weekly and daily series: calendars, lags, rolling and decayed sums.

A series is ordered by its date; `by` names the columns that tell series apart, so
that windows of different series run in different tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fathom.sources.scratch import written


def friday(day: Column) -> Column:
    """The Friday on or after a day."""
    return F.next_day(F.date_sub(day, 1), "FRI")


def over(date: str = "date", by: tuple[str, ...] = ()) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(date)


def weekly(daily: DataFrame, how: dict[str, Column], zero: tuple[str, ...] = (), date: str = "date") -> DataFrame:
    """Aggregates of each week to Friday, for every week from the first to the last;
    a week without rows has 0 in the columns of `zero` and nulls elsewhere."""
    sums = daily.groupBy(friday(F.col(date)).alias("_w")).agg(*(c.alias(k) for k, c in how.items()))
    ends = sums.agg(F.min("_w").alias("a"), F.max("_w").alias("b")).where("a is not null")
    weeks = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias(date))
    return weeks.join(sums, weeks[date] == sums["_w"], "left").drop("_w").na.fill(0, list(zero))


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in an order that must be total."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def lagged(rows: DataFrame, columns: list[str], date: str = "date", by: tuple[str, ...] = ()) -> DataFrame:
    """Columns replaced by those of the row before, named with _lag1."""
    w = over(date, by)
    return rows.select("*", *(F.lag(c).over(w).alias(f"{c}_lag1") for c in columns)).drop(*columns)


def change(column: Column, w: WindowSpec, k: int = 1) -> Column:
    """Percent change against k rows before."""
    return (F.try_divide(column, F.lag(column, k).over(w)) - 1) * 100


def rolling(how, column: str, w: WindowSpec, rows: int, least: int) -> Column:
    """An aggregate of the last rows, null below `least` values."""
    frame = w.rowsBetween(1 - rows, 0)
    return F.when(F.count(column).over(frame) >= least, how(column).over(frame))


def volatility(rows: DataFrame, column: str, date: str = "date", by: tuple[str, ...] = (), window: int = 8, least: int = 4) -> DataFrame:
    return rows.withColumn("realized_vol", rolling(F.stddev_samp, column, over(date, by), window, least))


def clipped_volatility(rows: DataFrame, column: str, floor: float = 0.5, date: str = "date", by: tuple[str, ...] = ()) -> DataFrame:
    """Volatility of at least `floor`; rows before the first value take that value."""
    w = over(date, by)
    vol = volatility(rows, column, date, by).withColumn("_v", F.when(F.col("realized_vol").isNotNull(), F.greatest("realized_vol", F.lit(floor))))
    return vol.withColumn("realized_vol", F.first("_v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).drop("_v")


def zscore(column: str, w: WindowSpec, rows: int = 52, least: int = 8) -> Column:
    """Rolling z-score with a floor of 1e-6 under the deviation; 0 where undefined."""
    mean, std = (rolling(f, column, w, rows, least) for f in (F.avg, F.stddev_samp))
    return F.coalesce((F.col(column) - mean) / F.greatest(std, F.lit(1e-6)), F.lit(0.0))


def seasonal_surprise(rows: DataFrame, column: str, date: str = "date", by: tuple[str, ...] = (), least: int = 4) -> Column:
    """Value less the mean of the same ISO week so far, this row included."""
    frame = Window.partitionBy(*by, F.weekofyear(date)).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return F.col(column) - F.when(F.count(column).over(frame) >= least, F.avg(column).over(frame))


def decayed(rows: DataFrame, columns: dict[str, str], date: str = "date", by: tuple[str, ...] = (), n: float = 4) -> DataFrame:
    """rows with columns {new: x}: y[t] = x[t] + exp(-1/n) * y[t-1], nulls as 0. Running
    sums of x[t] * exp(t/n) start afresh after 100 * n rows, so that they stay in range;
    what the stretch before leaves is carried, and what is older is below any rounding."""
    w, size = over(date, by), max(1, math.ceil(100 * n))
    rows = rows.withColumn("_t", F.row_number().over(w) - 1).withColumn("_at", (F.col("_t") % size).cast("double")).withColumn("_part", F.floor(F.col("_t") / size))
    part, ahead = over(date, (*by, "_part")).rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    inside = {x: F.sum(F.coalesce(F.col(x).cast("double"), F.lit(0.0)) * F.exp(F.col("_at") / n)).over(part) * F.exp(-F.col("_at") / n) for x in columns.values()}
    rows = rows.withColumns({f"_in_{x}": c for x, c in inside.items()})
    left = {x: F.coalesce(F.last(F.when(F.col("_at") == size - 1, F.col(f"_in_{x}")), ignorenulls=True).over(ahead), F.lit(0.0)) for x in columns.values()}
    rows = rows.withColumns({new: F.col(f"_in_{x}") + left[x] * F.exp(-(F.col("_at") + 1) / n) for new, x in columns.items()})
    return rows.drop("_t", "_at", "_part", *(f"_in_{x}" for x in columns.values()))


def growth(percent: Column, w: WindowSpec) -> Column:
    """Cumulative product of 1 + percent / 100, less 1."""
    return F.product(1 + percent / 100).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1


def near_events(days: DataFrame, events: DataFrame, before: int, after: int, date: str = "date") -> DataFrame:
    """Days within `before` days ahead of an event and `after` days behind it."""
    around = events.select(F.explode(F.sequence(F.date_sub(date, before), F.date_add(date, after))).alias(date)).distinct()
    return days.join(around, date, "left_semi")


def folds(rows: DataFrame, start: int, step: int, least: int = 1, date: str = "date", by: tuple[str, ...] = ()) -> DataFrame:
    """Numbers the test folds of an expanding walk-forward: rows after the first
    `start` in runs of `step`; a fold of fewer than `least` rows is left out. A
    fold trains on the rows whose number `rn` is at most `start + fold * step`."""
    numbered = rows.withColumn("rn", F.row_number().over(over(date, by)).cast("long")).where(F.col("rn") > start)
    fold = numbered.withColumn("fold", F.floor((F.col("rn") - 1 - start) / step).cast("long"))
    return fold.withColumn("_n", F.count("*").over(Window.partitionBy(*by, "fold"))).where(F.col("_n") >= least).drop("_n")


def inner_splits(n: int, splits: int = 3, size: int = 26, least: int = 104) -> list[int]:
    """Ends of the training parts of nested time splits, evenly spaced and distinct."""
    if n < least + size or splits < 1:
        return []
    last = n - size
    ends = [int(least + (last - least) * k / (splits - 1)) for k in range(splits)] if splits > 1 else [least]
    return sorted(set(ends))


def inner_split_rows(counts: DataFrame, splits: int = 3, size: int = 26, least: int = 104) -> DataFrame:
    """counts (n, ...) with `e`, the end of the training part of each of inner_splits(); a
    row of too few has none."""
    last = F.col("n") - size
    at = F.sequence(F.lit(0), F.lit(max(1, splits) - 1))
    ends = F.array_distinct(F.transform(at, lambda k: F.floor(F.lit(least) + (last - least) * k / max(1, splits - 1)).cast("long")))
    return counts.where(F.col("n") >= least + size).select("*", F.explode(ends).alias("e"))


def age_weights(w_all: WindowSpec, date: str = "date", base: float = 0.995) -> Column:
    """base ** age, over the mean of all; w_all is the unordered window of a series."""
    raw = F.pow(F.lit(base), F.row_number().over(w_all.orderBy(F.desc(date))) - 1)
    n = F.count("*").over(w_all)
    return raw / ((1 - F.pow(F.lit(base), n)) / (1 - base) / n)


def sequences(rows: DataFrame, columns: list[str], look: int = 4, date: str = "date", by: tuple[str, ...] = ()) -> DataFrame:
    """The `look` rows before each, as an array of structs; rows with fewer go."""
    frame = over(date, by).rowsBetween(-look, -1)
    return rows.withColumn("past", F.collect_list(F.struct(*columns)).over(frame)).where(F.size("past") == look)


def described(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column: number, mean, deviation, least, quartiles and largest. The
    quartiles are exact: equal values are counted, dealt by ranges, and numbered from the sums of
    the ranges before theirs, so that no task holds a column's values."""
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))).alias("e")).select("e.*")
    whole = each.groupBy("column").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    values = each.where("x is not null").groupBy("column", "x").agg(F.count("*").alias("n"))
    dealt = written(values.repartitionByRange("column", "x").withColumn("part", F.spark_partition_id()), "values")
    parts = dealt.groupBy("column", "part").agg(F.sum("n").alias("_n"))  # a row a range from here on
    before = parts.select("column", "part", (F.sum("_n").over(Window.partitionBy("column").orderBy("part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("column")).alias("_all"))
    upto = F.sum("n").over(Window.partitionBy("column", "part").orderBy("x")) + F.col("_before")
    numbered = dealt.join(F.broadcast(before), ["column", "part"]).withColumn("_upto", upto)
    quarters = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    at = {k: (F.col("_all") - 1) * q for k, q in quarters.items()}
    found = numbered.groupBy("column").agg(*(F.min(F.when(F.col("_upto") > f(at[k]), F.col("x"))).alias(f"_{k}_{name}") for k in quarters for name, f in (("low", F.floor), ("high", F.ceil))))
    low, high, place = ({k: F.col(f"_{k}_low") for k in quarters}, {k: F.col(f"_{k}_high") for k in quarters}, {k: (F.col("count") - 1) * q for k, q in quarters.items()})
    q = [F.when(low[k] == high[k], low[k]).otherwise((F.ceil(place[k]) - place[k]) * low[k] + (place[k] - F.floor(place[k])) * high[k]).alias(k) for k in quarters]
    return whole.join(F.broadcast(found), "column", "left").select("column", "count", "mean", "std", "min", *q, "max")
