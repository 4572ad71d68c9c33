"""Daily series: aggregation, moving average, forecast, seasonality, momentum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from datascry.operators.profile import instant, number
from datascry.operators.ranks import medians
from datascry.operators.relations import linear_fit

# A series has one row for each observed day, some thousands in ten years,
# whatever the table's size: its windows need no key.


def _all() -> WindowSpec:
    return W.partitionBy(F.lit(0))


def _time() -> WindowSpec:
    return _all().orderBy("day")


def daily_series(df: DataFrame, date: str, metric: str | None, agg: str = "sum") -> DataFrame:
    """``day, value, n`` of observed days; ``agg`` is sum, mean or count."""
    base = df.select(F.to_date(instant(df, date)).alias("day"), (number(df, metric) if metric else F.lit(1.0)).alias("v"))
    base = base.filter("day is not null and v is not null")
    value = {"sum": F.sum("v"), "mean": F.avg("v"), "count": F.count("v").cast("double")}[agg]
    return base.groupBy("day").agg(value.alias("value"), F.count("v").alias("n"))


def moving_average(series: DataFrame, points: int = 7) -> DataFrame:
    """Mean of the last ``points`` observed days, fewer at the start."""
    return series.withColumn("ma", F.avg("value").over(_time().rowsBetween(1 - points, 0)))


def trim_partial(series: DataFrame, least: int = 8) -> DataFrame:
    """Drops last days with under half the median rows, down to ``least`` points."""
    median = series.agg(F.percentile("n", F.lit(0.5)).alias("med"))
    placed = series.join(F.broadcast(median)).withColumn("i", F.row_number().over(_time()))
    good = F.max(F.when(F.col("n") >= 0.5 * F.col("med"), F.col("i"))).over(_all())
    return placed.withColumn("upto", F.greatest(F.coalesce(good, F.lit(0)), F.lit(least))).filter("i <= upto").select("day", "value", "n")


def _days(c: Column, first: Column) -> Column:
    return F.datediff(c, first).cast("double")


def fit_series(series: DataFrame) -> DataFrame:
    """Least squares on days since the start, with first, last and count of days."""
    placed = series.withColumn("first", F.min("day").over(_all()))
    ends = series.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    return linear_fit(placed, _days(F.col("day"), F.col("first")), F.col("value")).join(F.broadcast(ends))


def forecast(series: DataFrame, horizon: int | None = None) -> DataFrame:
    """``day, value, lower, upper``: the line beyond the last day, with its band.

    The horizon is a quarter of the span, 14 days at least; a step is the mean
    gap between observed days.  Series of under 4 points give none.
    """
    span = F.datediff("last", "first")
    ahead = F.lit(horizon) if horizon else F.greatest(F.lit(14), F.round(span * 0.25).cast("int"))
    step = F.greatest(F.lit(1), F.round(span / (F.col("n") - 1)).cast("int"))
    fit = fit_series(series).filter("n >= 4").withColumns({"span": span, "ahead": ahead}).withColumn("step", step)
    x = F.col("x").cast("double")
    mid = F.col("intercept") + F.col("slope") * x
    band = 1.96 * F.col("se") * F.sqrt(1.0 + 1.0 / F.col("n") + F.coalesce(F.try_divide(F.pow(x - F.col("mean_x"), 2), F.col("sxx")), F.lit(0.0)))
    return (
        fit.withColumn("x", F.explode(F.sequence(F.col("span") + F.col("step"), F.col("span") + F.greatest("ahead", "step"), F.col("step"))))
        .select(F.date_add("first", F.col("x")).alias("day"), mid.alias("value"), (mid - band).alias("lower"), (mid + band).alias("upper"))
    )


def _seasonal(series: DataFrame, part: Column, parts: int, least_points: int, least_span: int) -> DataFrame:
    whole = series.agg(F.count(F.lit(1)).alias("points"), F.avg("value").alias("overall"), F.datediff(F.max("day"), F.min("day")).alias("span"))
    groups = series.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    held = groups.agg(F.count(F.lit(1)).alias("held"), F.min("n").alias("fewest"))
    return (
        groups.join(F.broadcast(whole)).join(F.broadcast(held))
        .filter((F.col("points") >= 56) & (F.col("span") >= least_span) & (F.col("held") == parts) & (F.col("fewest") >= least_points))
        .select("part", "n", "mean", F.coalesce(F.try_divide(F.col("mean") * 100.0, "overall"), F.lit(100.0)).alias("index"))
    )


def weekday_seasonality(series: DataFrame) -> DataFrame:
    """``part`` (Sunday 0), n, mean and index; needs 56 days and 8 of each weekday."""
    return _seasonal(series, F.dayofweek("day") - 1, 7, 8, 56)


def month_seasonality(series: DataFrame) -> DataFrame:
    """``part`` (January 0), n, mean and index; needs two years and 2 days of each month."""
    return _seasonal(series, F.month("day") - 1, 12, 2, 730)


def month_breakdown(df: DataFrame, date: str, metric: str, cuts: Sequence[float] | None = None) -> DataFrame:
    """Months with n, sum, mean, median, min, max and change on the month listed before; ``cuts``
    of the metric as in :func:`ranks.exact_quantiles`."""
    base = df.select(F.date_format(instant(df, date), "yyyy-MM").alias("month"), number(df, metric).alias("v")).filter("month is not null and v is not null")
    months = base.groupBy("month").agg(
        F.count("v").alias("n"), F.sum("v").alias("sum"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max")
    ).join(medians(base, {"v": F.col("v")}, ["month"], cuts and {"v": cuts}, few=True).select("month", "median"), "month")
    before = F.lag("sum").over(_all().orderBy("month"))
    return months.withColumn("change_pct", F.try_divide((F.col("sum") - before) * 100.0, F.abs(before)))


def month_extremes(months: DataFrame) -> DataFrame:
    """Best and worst month by sum (the earlier of equals) of a :func:`month_breakdown`
    of two months or more."""
    early = F.negative(F.regexp_replace("month", "-", "").cast("int"))
    return months.agg(
        F.count(F.lit(1)).alias("months"), F.max_by("month", F.struct(F.col("sum"), early)).alias("best_month"), F.max("sum").alias("best"),
        F.min_by("month", F.struct(F.col("sum"), F.negative(early))).alias("worst_month"), F.min("sum").alias("worst"),
    ).filter("months >= 2")


def momentum(series: DataFrame) -> DataFrame:
    """Means of the first and second half of the points, and the change."""
    placed = series.withColumn("i", F.row_number().over(_time())).withColumn("half", F.floor(F.count(F.lit(1)).over(_all()) / 2))
    got = placed.agg(
        F.avg(F.when(F.col("i") <= F.col("half"), F.col("value"))).alias("prior"),
        F.avg(F.when(F.col("i") > F.col("half"), F.col("value"))).alias("recent"),
        F.count(F.lit(1)).alias("points"),
        F.min(F.when(F.col("i") > F.col("half"), F.col("day"))).alias("split"),
    ).filter("points >= 8")
    return got.withColumn("change_pct", F.coalesce(F.try_divide((F.col("recent") - F.col("prior")) * 100.0, F.abs("prior")), F.lit(0.0)))


def extremes(series: DataFrame) -> DataFrame:
    """Best and worst day (the earlier of equals) and the median, from 8 points on."""
    best = F.max(F.struct(F.col("value"), F.negative(F.datediff("day", F.lit("1970-01-01"))).alias("d"), F.col("day")))
    worst = F.min(F.struct(F.col("value"), F.datediff("day", F.lit("1970-01-01")).alias("d"), F.col("day")))
    return (
        series.agg(best.alias("b"), worst.alias("w"), F.percentile("value", F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("points"))
        .filter("points >= 8")
        .select(F.col("b.day").alias("best_day"), F.col("b.value").alias("best"), F.col("w.day").alias("worst_day"), F.col("w.value").alias("worst"), "median")
    )


def volatility(series: DataFrame) -> DataFrame:
    """Median absolute step in percent (steps from 0 left out) and coefficient of variation."""
    before = F.lag("value").over(_time())
    steps = series.withColumn("step", F.when(before != 0, F.abs((F.col("value") - before) / F.abs(before)) * 100.0))
    return (
        steps.agg(
            F.percentile("step", F.lit(0.5)).alias("median_step"),
            F.coalesce(F.try_divide(F.stddev_samp("value"), F.abs(F.avg("value"))), F.lit(0.0)).alias("cv"),
            F.count(F.lit(1)).alias("points"),
        )
        .filter("points >= 8 and median_step is not null")
        .drop("points")
    )


def series_anomalies(series: DataFrame, z: float = 3.0) -> DataFrame:
    """Days at least ``z`` sample deviations from the mean."""
    whole = series.agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).filter("sd > 0")
    score = (F.col("value") - F.col("mean")) / F.col("sd")
    return series.join(F.broadcast(whole)).select("day", "value", score.alias("z")).filter(F.abs("z") >= z)
