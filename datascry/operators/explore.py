"""What a user picks: pivots, group comparisons, Pareto, deciles, ordered trends, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from datascry.functions.special import corr_p, f_p
from datascry.functions.values import blank_key, ordinal_rank
from datascry.operators.profile import key_counts, number
from datascry.operators.ranks import cuts_of, exact_quantiles, in_buckets, in_pair_ranges, in_ranges, medians, sums_before
from datascry.operators.relations import _ranked_pair, correlation


def crosstab(df: DataFrame, row: str, col: str, metric: str | None = None, agg: str = "count") -> DataFrame:
    """``r, c, value, n``: mean, sum or count per cell; a cell without values is null.

    Counting with a metric counts its values, without one the rows.
    """
    base = df.select(blank_key(F.col(f"`{row}`")).alias("r"), blank_key(F.col(f"`{col}`")).alias("c"), (number(df, metric) if metric else F.lit(1.0)).alias("v"))
    value = {"mean": F.avg("v"), "sum": F.sum("v"), "count": F.count("v").cast("double")}[agg]
    return base.groupBy("r", "c").agg(F.when(F.count("v") > 0, value).alias("value"), F.count("v").alias("n"))


def pivot(df: DataFrame, row: str, col: str, metric: str | None = None, agg: str = "count", most: int = 16) -> DataFrame:
    """The crosstab as a table, at most ``most`` by ``most`` keys, largest groups first."""
    cells = crosstab(df, row, col, metric, agg)
    columns = [r[0] for r in cells.groupBy("c").agg(F.sum("n").alias("m")).orderBy(F.desc("m"), "c").limit(most).collect()]
    rows = cells.groupBy("r").agg(F.sum("n").alias("m")).orderBy(F.desc("m"), "r").limit(most).select("r")
    return cells.join(F.broadcast(rows), "r").groupBy("r").pivot("c", columns).agg(F.first("value"))


def _sums(df: DataFrame, column: str, metric: str | None) -> DataFrame:
    """``key, value``: sums of the metric, or rows, of each key that has any."""
    base = df.select(blank_key(F.col(f"`{column}`")).alias("key"), (number(df, metric) if metric else F.lit(1.0)).alias("v"))
    return base.filter("v is not null").groupBy("key").agg(F.sum("v").alias("value"))


def pareto(df: DataFrame, column: str, metric: str | None = None) -> DataFrame:
    """``key, value, place, share, cum_share``, largest first, ties by key.

    Rows without a number in ``metric`` are left out, so a key of such rows alone
    is no item.  Running sums go over ranges of (value, key) first, then within each, so
    keys of equal sums are no single range.
    """
    sums = _sums(df, column, metric)
    total = sums.agg(F.sum("value").alias("total")).select(F.when(F.col("total") == 0, 1.0).otherwise(F.col("total")).alias("total"))
    placed = sums_before(in_pair_ranges(sums, "value", "key").withColumn("one", F.lit(1)), places="one", above="value")
    order = W.partitionBy("range").orderBy(F.desc("value"), "key")
    return placed.join(F.broadcast(total)).select(
        "key", "value", (F.row_number().over(order) + F.col("places")).cast("int").alias("place"), (F.col("value") * 100.0 / F.col("total")).alias("share"),
        ((F.sum("value").over(order.rowsBetween(W.unboundedPreceding, 0)) + F.col("above")) * 100.0 / F.col("total")).alias("cum_share"),
    )


def paretos(df: DataFrame, columns: Sequence[str], metric: str | None = None) -> DataFrame:
    """``column`` and what :func:`pareto` says, of columns of few keys each: one grouping for all.

    A column's sums are one window; use :func:`pareto` for columns of many keys.
    """
    number_of = number(df, metric) if metric else F.lit(1.0)
    keys = F.array(*[F.struct(F.lit(c).alias("column"), blank_key(F.col(f"`{c}`")).alias("key")) for c in columns])
    return pareto_items(df.select(number_of.alias("v"), F.inline(keys)).filter("v is not null").groupBy("column", "key").agg(F.sum("v").alias("value")))


def pareto_items(sums: DataFrame) -> DataFrame:
    """:func:`paretos` of the sums ``column, key, value``."""
    order = W.partitionBy("column").orderBy(F.desc("value"), "key")
    total = F.sum("value").over(W.partitionBy("column"))
    whole = F.when(total == 0, 1.0).otherwise(total)
    upto = F.sum("value").over(order.rowsBetween(W.unboundedPreceding, 0))
    return sums.select(
        "column", "key", "value", F.row_number().over(order).alias("place"), (F.col("value") * 100.0 / whole).alias("share"), (upto * 100.0 / whole).alias("cum_share")
    )


def pareto_summary(items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``items, count_to_80, pct80, top_key, top_share`` of a :func:`pareto`, or by column of :func:`paretos`."""
    to80 = F.coalesce(F.min(F.when(F.col("cum_share") >= 80 - 1e-9, F.col("place"))), F.count(F.lit(1)))
    return items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"), to80.cast("long").alias("count_to_80"), (to80 * 100.0 / F.count(F.lit(1))).alias("pct80"),
        F.min_by("key", "place").alias("top_key"), F.min_by("share", "place").alias("top_share"),
    )


#: Bars of a Pareto chart, and keys of a volume profile and of a composition.
PARETO_BARS, VOLUME_BARS, COMPOSED = 14, 12, 8


def top_sums(df: DataFrame, column: str, metric: str | None = None, most: int = PARETO_BARS) -> DataFrame:
    """The ``most`` keys of largest sum (or most rows): ``key, value, place, share, cum_share``."""
    sums = _sums(df, column, metric)
    total = sums.agg(F.sum("value").alias("total")).select(F.when(F.col("total") == 0, 1.0).otherwise(F.col("total")).alias("total"))
    top = sums.orderBy(F.desc("value"), "key").limit(most)
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("value"), "key")  # over those few
    placed = top.withColumn("place", F.row_number().over(order)).withColumn("upto", F.sum("value").over(order.rowsBetween(W.unboundedPreceding, 0)))
    share = F.col("value") * 100.0 / F.col("total")
    return placed.join(F.broadcast(total)).select("key", "value", "place", share.alias("share"), (F.col("upto") * 100.0 / F.col("total")).alias("cum_share"))


def composition(df: DataFrame, column: str, metric: str | None = None, most: int = COMPOSED) -> DataFrame:
    """The ``most`` largest keys, by their sums of ``metric`` or by rows, with their share of the whole."""
    return top_sums(df, column, metric, most).drop("cum_share")


def volume_profile(df: DataFrame, column: str, metric: str) -> DataFrame:
    """How rows and sums of the metric spread over the largest keys: ``key, rows, value, place, share``."""
    base = df.select(blank_key(F.col(f"`{column}`")).alias("key"))
    rows = base.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    return top_sums(df, column, metric, VOLUME_BARS).join(rows, "key").select("key", "rows", "value", "place", "share")


def explorer_stats(df: DataFrame, metric: str, group: str) -> DataFrame:
    """``groups, eta2, p, overall``: variance between the groups of two or more
    values, its p, and the mean of all rows."""
    base = df.select(blank_key(F.col(f"`{group}`")).alias("key"), number(df, metric).alias("v")).filter("v is not null")
    each = base.groupBy("key").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("ss")).filter("n >= 2")
    # the spread of means about the grand mean, by the moments of the groups
    whole = each.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.sum("ss").alias("ssw"))
    between = each.join(F.broadcast(whole.select("grand"))).agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("ssb"))
    overall = base.agg(F.avg("v").alias("overall"))
    dfb, dfw = F.col("groups") - 1, F.col("n") - F.col("groups")
    f = F.when((F.col("ssw") == 0) & (F.col("ssb") > 0), F.lit(float("inf"))).otherwise(F.try_divide(F.col("ssb") / dfb, F.try_divide(F.col("ssw"), dfw.cast("double"))))
    return (
        whole.filter("groups >= 2").join(F.broadcast(between)).join(F.broadcast(overall))
        .withColumn("f", f)
        .select(
            "groups", F.coalesce(F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")), F.lit(0.0)).alias("eta2"),
            F.when(F.col("ssb") + F.col("ssw") > 0, f_p(F.col("f"), dfb, dfw)).alias("p"), "overall",
        )
    )


def group_explorer(df: DataFrame, metric: str, group: str, sort: str = "mean", top: int = 20) -> DataFrame:
    """Groups of two or more values with their statistics; ``sort`` is mean, n or name."""
    base = df.select(blank_key(F.col(f"`{group}`")).alias("key"), number(df, metric).alias("v")).filter("v is not null")
    got = base.groupBy("key").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.sum("v").alias("sum"), F.min("v").alias("min"), F.max("v").alias("max")
    ).filter("n >= 2")
    order = {"mean": [F.desc("mean")], "n": [F.desc("n")], "name": []}[sort]
    shown = got.orderBy(*order, "key").limit(top)
    q = exact_quantiles(base.join(F.broadcast(shown.select("key")), "key", "left_semi"), {"v": F.col("v")}, (0.25, 0.5, 0.75), ["key"])  # top keys
    return shown.join(q.select("key", "q"), "key").select(
        "key", "n", "mean", F.col("q")[1].alias("median"), "sd", "sum", "min", F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"), "max"
    )


def decile_share(df: DataFrame, metric: str, cuts: Sequence[float] | None = None) -> DataFrame:
    """``decile, n, sum, share`` of the sorted values, cut at floor(d n / 10).

    Values are counted and summed in buckets between ``cuts`` (sketched unless given).  A bucket covers
    a stretch of places; one within a decile goes there whole.  Of those that an edge divides, each value is
    counted, and each decile takes its part of the copies' stretch.
    """
    values = df.select(number(df, metric).alias("v")).filter("v is not null")
    put = in_buckets(values, {"v": cuts or cuts_of(values, {"v": F.col("v")})["v"]})
    every, upto = W.partitionBy(F.lit(0)), F.sum("m").over(W.partitionBy(F.lit(0)).orderBy("v_b").rowsBetween(W.unboundedPreceding, W.currentRow))
    sized = put.groupBy("v_b").agg(F.count(F.lit(1)).alias("m"), F.sum("v").alias("s"))  # some 2000 rows at most
    sized = sized.withColumns({"hi": upto, "n": F.sum("m").over(every), "total": F.sum("s").over(every)}).withColumn("lo", F.col("hi") - F.col("m"))
    edges = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda d: F.floor(d * F.col("n") / 10))
    sized = sized.withColumn("divided", (F.col("n") < 10) | F.exists(edges, lambda e: (F.col("lo") < e) & (e < F.col("hi"))))
    counts = put.join(F.broadcast(sized.filter("divided").select("v_b", "n", "total", F.col("lo").alias("before"))), "v_b").groupBy("v_b", "n", "total", "before", "v").agg(F.count(F.lit(1)).alias("m"))
    inside = F.coalesce(F.sum("m").over(W.partitionBy("v_b").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = counts.withColumn("lo", F.col("before") + inside).select("n", "total", "lo", (F.col("lo") + F.col("m")).alias("hi"), "v", F.lit(None).cast("double").alias("s"))
    spans = spans.unionByName(sized.filter("not divided").select("n", "total", "lo", "hi", F.lit(None).cast("double").alias("v"), "s"))
    each = spans.select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("d"))
    begin, end = F.floor(F.col("d") * F.col("n") / 10), F.floor((F.col("d") + 1) * F.col("n") / 10)
    end = F.greatest(end, F.least(begin + 1, F.col("n")))
    took = F.greatest(F.lit(0), F.least(F.col("hi"), end) - F.greatest(F.col("lo"), begin))
    sums = F.sum(F.coalesce(F.col("took") * F.col("v"), F.col("s")))
    parts = each.withColumn("took", took).filter("took > 0").groupBy("d").agg(F.sum("took").alias("n"), sums.alias("sum"), F.first("total").alias("total"))
    return parts.select(
        (F.col("d") + 1).alias("decile"), "n", "sum", (F.col("sum") * 100.0 / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))).alias("share")
    )


def ordered_trend(df: DataFrame, category: str, metric: str, cuts: Sequence[float] | None = None) -> DataFrame:
    """Levels of an ordered category with their rank, mean, change and the fitted line.

    Needs 3 to 12 levels, all ranked and no two alike; groups of 3 values and
    more count, and 3 such groups.
    """
    levels = key_counts(df, category).withColumn("rank", ordinal_rank(F.col("key")))
    usable = levels.agg(F.count(F.lit(1)).alias("k"), F.count("rank").alias("ranked"), F.count_distinct("rank").alias("apart")).filter(
        "k between 3 and 12 and ranked = k and apart = k"
    )
    base = df.select(F.trim(F.col(f"`{category}`").cast("string")).alias("key"), number(df, metric).alias("v"))
    groups = base.groupBy("key").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.sum("v").alias("sum")).filter("n >= 3")
    groups = groups.join(medians(base, {"v": F.col("v")}, ["key"], cuts and {"v": cuts}).select("key", "median"), "key")
    one = W.partitionBy(F.lit(0))
    out = levels.select("key", "rank").join(F.broadcast(usable)).join(groups, "key").withColumn("groups", F.count(F.lit(1)).over(one)).filter("groups >= 3")
    before = F.lag("mean").over(one.orderBy("rank"))
    return out.select(
        "key", "rank", "n", "mean", "median", "sum",
        F.try_divide((F.col("mean") - before) * 100.0, F.abs(before)).alias("change_pct"),
        F.regr_slope("mean", "rank").over(one).alias("slope"),
        F.regr_r2("mean", "rank").over(one).alias("r2"),
        (F.max_by("mean", "rank").over(one) - F.min_by("mean", "rank").over(one)).alias("swing"),
    )


def ordered_trends(df: DataFrame, categories: Sequence[str], metric: str, most: int = 4, cuts: Sequence[float] | None = None) -> DataFrame:
    """:func:`ordered_trend` of every category but the metric's own bands: the
    ``most`` of best fit, ``category, place`` first."""
    out = None
    cuts = cuts or cuts_of(df, {metric: number(df, metric)})[metric]
    for c in categories:
        if c != f"{metric} (quintile)":
            one = ordered_trend(df, c, metric, cuts).select(F.lit(c).alias("category"), "*")
            out = one if out is None else out.unionByName(one)
    if out is None:
        return df.sparkSession.createDataFrame([], ORDERED)
    # a few levels of each category
    place = F.dense_rank().over(W.partitionBy(F.lit(0)).orderBy(F.desc("r2"), "category"))
    return out.withColumn("place", place).filter(F.col("place") <= most).select("category", "place", *out.columns[1:])


ORDERED = "category string, place int, key string, rank double, n long, mean double, median double, sum double, change_pct double, slope double, r2 double, swing double"


def scatter_sample(df: DataFrame, x: str, y: str, row: str, most: int = 2000) -> DataFrame:
    """Every k-th of the complete pairs in row order, k such that at most ``most`` stay."""
    pairs = df.select(F.col(row).alias("row"), number(df, x).alias("x"), number(df, y).alias("y")).filter("x is not null and y is not null")
    n = pairs.agg(F.count(F.lit(1)).alias("n"))
    # the place of a row is that within its range of rows plus all before it
    placed = sums_before(in_ranges(pairs, "row").withColumn("one", F.lit(1)), before="one")
    place = F.row_number().over(W.partitionBy("range").orderBy("row")) - 1
    k = F.greatest(F.lit(1), F.ceil(F.col("n") / most))
    return (
        placed.withColumn("inside", place).join(F.broadcast(n))
        .filter((F.col("before") + F.col("inside")) % k == 0).select("row", "x", "y")
    )


def scatter_stats(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, r, rho, p and r squared of one pair, from 3 pairs on."""
    pair = df.select(number(df, x).alias("x"), number(df, y).alias("y")).filter("x is not null and y is not null")
    plain = pair.agg(F.count(F.lit(1)).alias("n"), correlation(F.col("x"), F.col("y")).alias("r")).filter("n >= 3")
    ranks = _ranked_pair(pair).agg(correlation(F.col("rx"), F.col("ry")).alias("rho"))
    return plain.join(F.broadcast(ranks)).select("n", "r", "rho", corr_p(F.col("r"), F.col("n")).alias("p"), (F.col("r") * F.col("r")).alias("r2"))
