"""Exact order statistics of any number of values: quantiles, ranks, running sums.

No task sorts or holds a whole column or group.  Sketches, which combine before
the shuffle, say about where a rank lies or how to cut values into ranges of
like size; counts then make the answer exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import inf, nextafter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Accuracy of the sketch: a rank is off by at most one in so many.
ACCURACY = 10_000
#: Ranges that values are cut into: at least, at most, and values of one.
LEAST_RANGES, MOST_RANGES, RANGE_VALUES = 16, 1024, 200_000
#: Ranges of (sum, key) pairs, and sampled pairs for each.
PAIR_RANGES, SAMPLED = 256, 16
#: Rank tables of fewer distinct values are broadcast (some 24 bytes a value); buckets are cut so that a
#: value that more than one in MOST_HOT rows has is a cut.
FEW_VALUES, MOST_HOT = 100_000, 1000


def cuts_of(df: DataFrame, values: Mapping[str, Column]) -> dict[str, list[float]]:
    """Sketched quantiles of each named value, ascending, fewer than :data:`MOST_HOT`.  They
    decide how even buckets are, nothing else, so cuts of a table serve its parts."""
    points = [i / MOST_HOT for i in range(1, MOST_HOT)]
    names, out = list(values), {}
    for at in range(0, len(names), 8):
        part = names[at : at + 8]
        row = df.agg(*[F.percentile_approx(values[c].cast("double"), points, ACCURACY).alias(f"c{i}") for i, c in enumerate(part)]).first()
        out |= {c: sorted({x + 0.0 for x in row[i] or () if abs(x) < inf}) for i, c in enumerate(part)}
    return out


def in_buckets(df: DataFrame, cuts: Mapping[str, Sequence[float]]) -> DataFrame:
    """``df`` with the bucket of each column in ``cuts`` as ``<column>_b``, null for null.

    Buckets rise with values.  Odd ones hold the one double that is a cut, so values frequent
    enough to be a cut have a bucket of their own; even ones what lies between two cuts.
    """
    splits = []
    for mine in cuts.values():
        ends = [-inf]
        for c in mine:
            if c > ends[-1] and nextafter(c, inf) < inf:
                ends += [c, nextafter(c, inf)]
        splits.append([*(ends if len(ends) > 1 else [-inf, 0.0, nextafter(0.0, inf)]), inf])
    names = [f"{c}_b" for c in cuts]
    put = Bucketizer(splitsArray=splits, inputCols=list(cuts), outputCols=names, handleInvalid="keep").transform(df)
    return put.withColumns({b: F.col(b).cast("int") for b in names})


def exact_quantiles(
    df: DataFrame, values: Mapping[str, Column], at: Sequence[float], by: Sequence[str] = (), cuts: Mapping[str, Sequence[float]] | None = None, few: bool = False
) -> DataFrame:
    """``by..., name, n, q``: for each group and named value, its count and its
    quantiles ``at``, by linear interpolation; no row where there is no value.

    Of the whole, a first scan brackets each rank: up to :data:`ACCURACY` values by the least and the most
    of all, beyond by the sketch with three times its error and two ranks more to both
    sides.  A second scan counts each value within a bracket, and what lies between brackets as one.

    Of groups, a first scan counts the values in buckets between ``cuts`` (of the whole, sketched
    unless given), which tells the buckets that hold the ranks asked for; a second one counts the
    values in those alone.  ``few`` says that groups are few enough to broadcast these buckets.
    """
    if by:
        return _quantiles_of_groups(df, values, [float(q) for q in at], by, cuts, few)
    names, k = list(values), len(at)
    order = sorted(range(k), key=lambda j: at[j])
    asked = [float(at[j]) for j in order]
    base = df.select(*[values[c].alias(f"v{i}") for i, c in enumerate(names)])
    # a rank is less than one in ACCURACY of the values wherever the sketch decides
    margin = 5.0 / ACCURACY
    points = [max(0.0, q - margin) for q in asked] + [min(1.0, q + margin) for q in asked]
    sketched = base.agg(
        *[
            F.struct(
                F.count(f"v{i}").alias("n"), F.percentile_approx(f"v{i}", points, ACCURACY).alias("p"), F.min(f"v{i}").alias("least"), F.max(f"v{i}").alias("most")
            ).alias(f"s{i}")
            for i in range(len(names))
        ]
    )

    def bracket(s: Column) -> Column:
        few = s["n"] <= ACCURACY
        lows = [s["least"] if q <= margin else F.when(few, s["least"]).otherwise(s["p"][j]) for j, q in enumerate(asked)]
        highs = [s["most"] if q >= 1 - margin else F.when(few, s["most"]).otherwise(s["p"][k + j]) for j, q in enumerate(asked)]
        return F.struct(s["n"].alias("n"), F.array(*lows).alias("lows"), F.array(*highs).alias("highs"))

    bounds = sketched.select(*[bracket(F.col(f"s{i}")).alias(f"b{i}") for i in range(len(names))])
    met = base.alias("l").join(F.broadcast(bounds).alias("r"))  # one row
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"l.v{i}").alias("v"), F.col(f"r.b{i}").alias("b")) for i in range(len(names))])
    each = met.select(F.inline(cells)).filter("v is not null")

    def how_many(conditions: Sequence[Column]) -> Column:
        out = F.lit(0)
        for c in conditions:
            out = out + c.cast("int")
        return out

    # brackets begin and end in ascending order: those from ``over`` to ``begun`` hold the value
    over, begun = how_many([F.col("b.highs")[j] < F.col("v") for j in range(k)]), how_many([F.col("b.lows")[j] <= F.col("v") for j in range(k)])
    part = ["i", "n"]
    placed = each.select("i", F.col("b.n").alias("n"), over.alias("over"), begun.alias("begun"), "v")
    counts = placed.groupBy(*part, "over", "begun", F.when(F.col("begun") > F.col("over"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("m"))
    # for a bracket that has not begun, a value is one of those below
    brackets = counts.filter(F.col("over") < k).select(*part, F.explode(F.sequence("over", F.lit(k - 1))).alias("j"), "begun", "v", "m")
    sums = brackets.groupBy(*part, "j", F.when(F.col("j") < F.col("begun"), F.col("v")).alias("v")).agg(F.sum("m").alias("m"))
    run = W.partitionBy(*part, "j").orderBy(F.col("v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
    place = (F.col("n") - 1) * F.element_at(F.array(*[F.lit(q) for q in asked]), F.col("j") + 1)
    found = (
        sums.withColumn("upto", F.sum("m").over(run))
        .withColumn("place", place)
        .groupBy(*part, "j", "place")
        .agg(F.min(F.when(F.col("upto") > F.floor("place"), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil("place"), F.col("v"))).alias("b"))
    )
    share = F.col("place") - F.floor("place")
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1.0 - share) * F.col("a") + share * F.col("b"))
    name_of = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("i") + 1)
    as_asked = F.element_at(F.array(*[F.lit(j) for j in order]), F.col("j") + 1)
    return (
        found.select("i", "n", F.struct(as_asked.alias("j"), value.alias("x")).alias("s"))
        .groupBy("i", "n")
        .agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["x"]).alias("q"))  # one for each quantile asked for
        .select(name_of.alias("name"), "n", "q")
    )


def _quantiles_of_groups(df: DataFrame, values: Mapping[str, Column], at: Sequence[float], by: Sequence[str], cuts: Mapping[str, Sequence[float]] | None, few: bool) -> DataFrame:
    names, ks = list(values), [f"k{i}" for i in range(len(by))]
    base = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, ks, strict=True)], *[values[c].alias(f"v{i}") for i, c in enumerate(names)])
    cuts = cuts or cuts_of(df, values)
    put = in_buckets(base, {f"v{i}": cuts[c] for i, c in enumerate(names)})
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("v"), F.col(f"v{i}_b").alias("b")) for i in range(len(names))])
    each = put.select(*ks, F.inline(cells)).filter("v is not null")
    group = W.partitionBy(*ks, "i")
    # a group has a row for each bucket at most
    counts = each.groupBy(*ks, "i", "b").agg(F.count(F.lit(1)).alias("m")).withColumns(
        {"upto": F.sum("m").over(group.orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow)), "n": F.sum("m").over(group)}
    )
    places = [(F.col("n") - 1) * F.lit(q) for q in at]
    held = F.lit(False)
    for rank in [r for p in places for r in (F.floor(p), F.ceil(p))]:
        held = held | ((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("m")))
    asked = counts.filter(held).select(*ks, "i", "b", "n", (F.col("upto") - F.col("m")).alias("before"))
    hit = (F.col("l.i") == F.col("r.i")) & (F.col("l.b") == F.col("r.b"))
    for c in ks:
        hit = hit & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    met = each.alias("l").join((F.broadcast(asked) if few else asked).alias("r"), hit).select(*[f"r.{c}" for c in (*ks, "i", "b", "n", "before")], "l.v")
    seen = met.groupBy(*ks, "i", "b", "n", "before", "v").agg(F.count(F.lit(1)).alias("m"))
    run = W.partitionBy(*ks, "i", "b").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = [F.min(F.when(F.col("upto") > end(p), F.col("v"))).alias(f"{side}{j}") for j, p in enumerate(places) for side, end in (("a", F.floor), ("b", F.ceil))]
    found = seen.withColumn("upto", F.col("before") + F.sum("m").over(run)).groupBy(*ks, "i", "n").agg(*ends)

    def between(j: int, place: Column) -> Column:
        a, b, share = F.col(f"a{j}"), F.col(f"b{j}"), place - F.floor(place)
        return F.when(a == b, a).otherwise((1.0 - share) * a + share * b)

    name_of = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("i") + 1)
    q = F.array(*[between(j, p) for j, p in enumerate(places)])
    return found.select(*[F.col(k).alias(c) for c, k in zip(by, ks, strict=True)], name_of.alias("name"), "n", q.alias("q"))


def medians(df: DataFrame, values: Mapping[str, Column], by: Sequence[str], cuts: Mapping[str, Sequence[float]] | None = None, few: bool = False) -> DataFrame:
    """``by..., name, median``."""
    return exact_quantiles(df, values, (0.5,), by, cuts, few).select(*[f"`{c}`" for c in by], "name", F.col("q")[0].alias("median"))


# ------------------------------------------------------------ ranges


def below(cuts: Column, value: Column, most: int) -> Column:
    """How many of the ascending ``cuts``, at most ``most``, are less than ``value``, by halving."""
    steps = [1 << b for b in reversed(range(most.bit_length()))]
    size = F.size(cuts)
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda lo, s: F.when((lo + s <= size) & (F.get(cuts, lo + s - 1) < value), lo + s).otherwise(lo)
    )


def range_cuts(df: DataFrame, value: str) -> DataFrame:
    """``cuts``: sketched quantiles of the values, as many as keep the ranges between them small."""
    points = [i / MOST_RANGES for i in range(1, MOST_RANGES)]
    whole = df.agg(F.percentile_approx(value, points, ACCURACY).alias("cuts"), F.approx_count_distinct(value).alias("d"))
    wanted = F.greatest(F.lit(LEAST_RANGES), F.least(F.lit(MOST_RANGES), F.ceil(F.col("d") / RANGE_VALUES)))
    stride = F.floor(F.lit(MOST_RANGES) / wanted)
    chosen = F.transform(F.sequence(F.lit(1), F.floor(F.lit(MOST_RANGES - 1) / F.col("stride"))), lambda i: F.col("cuts")[(i * F.col("stride")).cast("int") - 1])
    return whole.withColumn("stride", stride).select(F.array_distinct(chosen).alias("cuts"))


def in_ranges(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``range``: values cut at sketched quantiles, so many ranges as
    keep them small; equal values are in one range and ranges rise with values."""
    met = df.join(F.broadcast(range_cuts(df, value)))  # one row
    return met.withColumn("range", below(F.col("cuts"), F.col(value), MOST_RANGES)).drop("cuts")


def in_pair_ranges(df: DataFrame, value: str, key: str) -> DataFrame:
    """``df`` with ``range``, which rises as (falling ``value``, rising ``key``) does: equal
    values are cut by their keys.  Cut points come from a sample of bounded size; they
    decide how even the ranges are, nothing else."""
    pair = F.struct((-F.col(value)).alias("a"), F.col(key).alias("b"))
    sample = df.select(pair.alias("pair"), F.xxhash64(key).alias("h")).orderBy("h").limit(PAIR_RANGES * SAMPLED)
    picked = sample.agg(F.sort_array(F.collect_list("pair")).alias("all"))
    cuts = picked.select(F.filter("all", lambda x, i: i % SAMPLED == SAMPLED - 1).alias("cuts"))
    return df.join(F.broadcast(cuts)).withColumn("range", below(F.col("cuts"), pair, PAIR_RANGES)).drop("cuts")  # one row


def sums_before(placed: DataFrame, **sums: str) -> DataFrame:
    """``placed`` (with ``range``) with, for each ``name=column``, the sum of the
    column over all ranges before the row's own."""
    totals = placed.groupBy("range").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    # at most MOST_RANGES rows
    earlier = W.partitionBy(F.lit(0)).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("range", *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(name) for name in sums])
    return placed.join(F.broadcast(before), "range")


# ------------------------------------------------------------ ranks


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """``value, n, rank`` of the distinct values: how many rows, and their rank, ties at their mean.

    Values are counted first; ranks come from counts over ranges of values and
    running sums within one.
    """
    counts = df.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n")).filter("v is not null")
    placed = sums_before(in_ranges(counts, "v"), before="n")
    within = W.partitionBy("range").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n").over(within), F.lit(0))
    return placed.withColumn("inside", inside).select(F.col("v").alias(value), "n", (F.col("before") + F.col("inside") + (F.col("n") + 1) / 2.0).alias("rank"))


def with_ranks(df: DataFrame, columns: Sequence[str], names: Sequence[str], cuts: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """``df`` with the mean rank of each column's value, a double, as ``names``; null stays null.

    Tables of few values are broadcast (a scan has estimated how many there are).  Rows of other
    columns are dealt by buckets between ``cuts`` (sketched unless given) and sorted within one; a
    bucket of a single value has one rank, so its rows are not dealt by it, and no value that moves is hot.
    """
    seen = df.agg(F.count(F.lit(1)).alias("rows"), *[F.approx_count_distinct(f"`{c}`").alias(f"d{i}") for i, c in enumerate(columns)]).first()
    many = [c for i, c in enumerate(columns) if seen[f"d{i}"] > FEW_VALUES]
    cuts = cuts_of(df, {c: F.col(f"`{c}`") for c in many}) if cuts is None and many else cuts
    source = df
    for c, name in zip(columns, names, strict=True):
        value = F.col(f"`{c}`")
        if c not in many:
            few = value_ranks(source.select(value.alias("v")), "v").select(F.col("v").alias("_v"), F.col("rank").alias(name))
            df = df.join(F.broadcast(few), value == F.col("_v"), "left").drop("_v")
            continue
        # zero has no sign here, since both zeros are one value
        sizes = in_buckets(source.select((value.cast("double") + F.lit(0.0)).alias("_v")), {"_v": cuts[c]}).filter("_v is not null").groupBy("_v_b").agg(F.count(F.lit(1)).alias("_m"))
        before = F.coalesce(F.sum("_m").over(W.partitionBy(F.lit(0)).orderBy("_v_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # 2 * MOST_HOT rows at most
        df = in_buckets(df.withColumn("_v", value.cast("double") + F.lit(0.0)), {"_v": cuts[c]})
        df = df.join(F.broadcast(sizes.withColumn("_before", before)), "_v_b", "left")
        # settled rows have their rank, or none: they stay together as they lie
        settled = F.col("_v").isNull() | (F.col("_v_b") % 2 == 1)
        df = df.withColumn("_deal", F.when(settled, -1 - F.spark_partition_id()).otherwise(F.col("_v_b")))
        order = W.partitionBy("_deal").orderBy(F.when(~settled, F.col("_v")))
        inside = (F.rank().over(order) + F.count(F.lit(1)).over(order)) / 2.0  # the first and the last place of its ties
        rank = F.when(F.col("_v").isNotNull(), F.col("_before") + F.when(settled, (F.col("_m") + 1) / 2.0).otherwise(inside))
        df = df.withColumn(name, rank).drop("_v", "_v_b", "_m", "_before", "_deal")
    return df
