"""Relations between columns: correlation, analysis of variance, overlap,
segments, bins and outliers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from datascry.functions import special
from datascry.functions.values import blank_key, finite, fmt_num, strength_label, trimmed
from datascry.operators.profile import FIFTHS, key_counts, number
from datascry.operators.ranks import cuts_of, exact_quantiles, medians, with_ranks

INF = float("inf")


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r of the rows that have both; null without variance, where Spark's own
    function fails under ANSI rules."""
    both = x.isNotNull() & y.isNotNull()
    u, v = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(u, v), F.sqrt(F.var_pop(u) * F.var_pop(v)))
    return F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)


#: Columns on each side of a block of pairs.
BLOCK = 5


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``a, b, n, r`` for all pairs of columns, pairwise complete.

    All pairs come from one scan and one grouping: a row goes to each block of
    :data:`BLOCK` columns by as many others, and a block's group holds the moments
    of its pairs.  r is null below 3 pairs or without variance.
    """
    base = df.select(*[number(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    size = min(BLOCK, len(columns))
    starts = range(0, len(columns), size)
    blocks = [(p, q) for p in starts for q in starts if p <= q]

    def side(name: str, at: int) -> list[Column]:
        return [(F.col(f"x{at + k}") if at + k < len(columns) else F.lit(None).cast("double")).alias(f"{name}{k}") for k in range(size)]

    rows = base.select(F.inline(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), *side("a", p), *side("b", q)) for p, q in blocks])))
    pairs = []
    for k in range(size):
        for m in range(k + 1 if len(blocks) == 1 else 0, size):
            x, y = F.col(f"a{k}"), F.col(f"b{m}")
            n = F.count_if(x.isNotNull() & y.isNotNull())
            pairs.append(F.struct(F.lit(k).alias("k"), F.lit(m).alias("m"), n.alias("n"), correlation(x, y).alias("r")))
    found = rows.groupBy("p", "q").agg(F.array(*pairs).alias("pairs")).select("p", "q", F.inline("pairs"))
    i, j = F.col("p") + F.col("k"), F.col("q") + F.col("m")
    names = F.array(*[F.lit(c) for c in columns])
    return found.filter((i < j) & (j < len(columns))).select(
        F.get(names, i).alias("a"), F.get(names, j).alias("b"), "n", F.when(F.col("n") >= 3, F.col("r")).alias("r")
    )


def spearman_pairs(df: DataFrame, columns: Sequence[str], cuts: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """``a, b, rho``: correlation of average ranks after pairwise deletion.

    Ranks of all columns without gaps come from one pass, for all their pairs; a
    pair with gaps is ranked by itself.  ``cuts`` are those of :func:`ranks.cuts_of`, sketched unless given.
    """
    base = df.select(*[number(df, c).alias(c) for c in columns])
    row = base.agg(F.count(F.lit(1)).alias("_all"), *[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(columns)]).first()
    whole = [c for i, c in enumerate(columns) if row[f"n{i}"] == row["_all"]]
    out = None
    if len(whole) > 1:
        plain = base.select(*[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(whole)])
        ranks = with_ranks(plain, plain.columns, [f"r{i}" for i in range(len(whole))], cuts and {f"v{i}": cuts[c] for i, c in enumerate(whole)})
        pairs = list(combinations(range(len(whole)), 2))
        rhos = [F.struct(F.lit(whole[i]).alias("a"), F.lit(whole[j]).alias("b"), correlation(F.col(f"r{i}"), F.col(f"r{j}")).alias("rho")) for i, j in pairs]
        out = ranks.agg(F.array(*rhos).alias("rows")).select(F.inline("rows"))
    for a, b in combinations(columns, 2):
        if a in whole and b in whole:
            continue
        pair = base.select(F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")).filter("x is not null and y is not null")
        one = _ranked_pair(pair, cuts and {"x": cuts[a], "y": cuts[b]}).agg(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(F.col("rx"), F.col("ry")).alias("rho"))
        out = one if out is None else out.unionByName(one)
    return out


def _ranked_pair(pair: DataFrame, cuts: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """``x, y`` with their average ranks ``rx, ry``."""
    return with_ranks(pair, ["x", "y"], ["rx", "ry"], cuts)


#: Ranks that agree by so much more than values do speak of a curve.
CURVED = 0.15


def links(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairs with at least 8 rows: ``a, b, n, r``, p, adjusted p and labels, without ranks."""
    found = pearson_pairs(df, columns).filter("n >= 8 and r is not null")
    out = special.adjust(found.withColumn("p", special.corr_p(F.col("r"), F.col("n"))))
    return out.withColumns({"strength": strength_label(F.col("r")), "duplicate": F.abs("r") > 0.999})


def correlations(df: DataFrame, columns: Sequence[str], cuts: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """:func:`links` with rho, and whether the ranks show a curve."""
    both = pearson_pairs(df, columns).filter("n >= 8 and r is not null").join(spearman_pairs(df, columns, cuts), ["a", "b"])
    out = special.adjust(both.withColumn("p", special.corr_p(F.col("r"), F.col("n"))))
    return out.withColumns(
        {
            "strength": strength_label(F.col("r")),
            "nonlinear": F.abs("rho") - F.abs("r") > CURVED,
            "duplicate": F.abs("r") > 0.999,
        }
    )


def corr_matrix(df: DataFrame, columns: Sequence[str], most: int = 14, least_rows: int = 6) -> DataFrame:
    """``a, b, r`` for every ordered pair of the first ``most`` columns, each with itself
    too; r is null for pairs with fewer than ``least_rows`` rows."""
    shown = list(columns)[:most]
    pairs = pearson_pairs(df, shown).select("a", "b", F.when(F.col("n") >= least_rows, F.col("r")).alias("r"))
    own = df.sparkSession.createDataFrame([(c, c, 1.0) for c in shown], "a string, b string, r double")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")).unionByName(own)


def linear_fit(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """Least squares of y on x: n, slope, intercept, r2, se, sxx, mean x."""
    xy = df.select(finite(x).alias("x"), finite(y).alias("y")).filter("x is not null and y is not null")
    sxx, sxy, syy, n = F.regr_sxx("y", "x"), F.regr_sxy("y", "x"), F.regr_syy("y", "x"), F.count(F.lit(1))
    slope = F.coalesce(F.try_divide(sxy, sxx), F.lit(0.0))
    residual = F.greatest(F.lit(0.0), syy - slope * sxy)
    return xy.agg(
        n.alias("n"),
        slope.alias("slope"),
        (F.avg("y") - slope * F.avg("x")).alias("intercept"),
        F.coalesce(1.0 - F.try_divide(residual, syy), F.lit(0.0)).alias("r2"),
        F.sqrt(F.try_divide(residual, (n - 2).cast("double"))).alias("se"),
        sxx.alias("sxx"),
        F.avg("x").alias("mean_x"),
    )


# ------------------------------------------------------------ drivers


def group_moments(df: DataFrame, categories: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``driver, metric, level`` with n, mean, variance, min, max, sum.

    One grouping covers all categories and metrics; the blank level is a group
    like any other.
    """
    rows = _by_level(df, categories, [number(df, m).alias(f"m{j}") for j, m in enumerate(metrics)])
    stats = [
        F.struct(
            F.lit(m).alias("metric"),
            F.count(f"m{j}").alias("n"),
            F.avg(f"m{j}").alias("mean"),
            F.coalesce(F.var_samp(f"m{j}"), F.lit(0.0)).alias("var"),
            F.min(f"m{j}").alias("lo"),
            F.max(f"m{j}").alias("hi"),
            F.sum(f"m{j}").alias("sum"),
        )
        for j, m in enumerate(metrics)
    ]
    return rows.groupBy("driver", "level").agg(F.array(*stats).alias("s")).select("driver", "level", F.inline("s"))


def level_cells(df: DataFrame, categories: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """A row for each combination of levels that occurs: trimmed levels ``c0, ...`` (blank: empty), ``rows``, and for
    each metric ``m0, ...`` its n, mean, sum of squares about it, min, max and sum.

    One scan without copies of rows; what is asked of levels and of their pairs follows from these
    rows.  Meant for so few categories that there are far fewer combinations than rows.
    """
    base = df.select(
        *[F.coalesce(trimmed(F.col(f"`{c}`")), F.lit("")).alias(f"c{i}") for i, c in enumerate(categories)], *[number(df, m).alias(f"v{j}") for j, m in enumerate(metrics)]
    )
    stats = []
    for j in range(len(metrics)):
        v = f"v{j}"
        parts = (F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("ss"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.sum(v).alias("sum"))
        stats.append(F.struct(*parts).alias(f"m{j}"))
    return base.groupBy(*[f"c{i}" for i in range(len(categories))]).agg(F.count(F.lit(1)).alias("rows"), *stats)


def _pooled(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by`` with the moments of their rows together: squares are about the common mean, so nothing cancels."""
    group = W.partitionBy(*by)
    mean = F.try_divide(F.sum(F.col("n") * F.col("mean")).over(group), F.sum("n").over(group).cast("double"))
    return parts.withColumn("common", mean).groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.first("common").alias("mean"),
        F.coalesce(F.sum(F.col("ss") + F.col("n") * F.pow(F.col("mean") - F.col("common"), 2)), F.lit(0.0)).alias("ss"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("sum").alias("sum"),
    )


def moments_of(cells: DataFrame, categories: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """What :func:`group_moments` says, with the ``rows`` of each level, from the :func:`level_cells` of the same names."""
    levels = F.array(*[F.struct(F.lit(c).alias("driver"), blank_key(F.col(f"c{i}")).alias("level")) for i, c in enumerate(categories)])
    stats = F.array(*[F.struct(F.lit(m).alias("metric"), *[F.col(f"m{j}")[k].alias(k) for k in ("n", "mean", "ss", "lo", "hi", "sum")]) for j, m in enumerate(metrics)])
    each = cells.select("rows", stats.alias("s"), F.inline(levels)).select("rows", "driver", "level", F.inline("s"))
    var = F.coalesce(F.try_divide(F.col("ss"), F.when(F.col("n") > 1, F.col("n") - 1.0)), F.lit(0.0))
    return _pooled(each, ["driver", "level", "metric"]).select("driver", "level", "metric", "n", "mean", var.alias("var"), "lo", "hi", "sum", "rows")


def driver_effects(moments: DataFrame, min_group: int = 3, max_levels: int = 40) -> DataFrame:
    """One-way analysis of variance for each driver and metric of ``moments``.

    Groups of at least ``min_group`` values; 2 to ``max_levels`` of them.  A driver
    whose groups hardly overlap restates the metric and is left out before the
    false-discovery adjustment.
    """
    by = ["driver", "metric"]
    groups = moments.filter(F.col("n") >= min_group)
    pair = W.partitionBy(*by)
    grand = F.sum(F.col("n") * F.col("mean")).over(pair) / F.sum("n").over(pair)
    nxt = F.lead("lo").over(pair.orderBy("lo", "hi", "level"))
    parts = groups.withColumn("grand", grand).withColumn("apart", F.when(nxt.isNotNull(), (F.col("hi") <= nxt).cast("double")))
    k, n = F.count(F.lit(1)), F.sum("n")
    out = parts.groupBy(*by).agg(
        k.alias("levels"),
        n.alias("n"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("ssw"),
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("ssb"),
        F.first("grand").alias("overall"),
        F.avg("apart").alias("apart"),
        F.max_by(F.struct("level", "mean", "n"), F.struct("mean", "level")).alias("top"),
        F.min_by(F.struct("level", "mean", "n"), F.struct("mean", "level")).alias("bottom"),
    )
    dfb, dfw = F.col("levels") - 1, F.col("n") - F.col("levels")
    sst = F.col("ssb") + F.col("ssw")
    msw = F.try_divide(F.col("ssw"), dfw.cast("double"))
    f = F.when((F.col("ssw") == 0) & (F.col("ssb") > 0), F.lit(INF)).when(F.col("ssw") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("ssb") / dfb, msw))
    omega = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("ssb") - dfb * F.coalesce(msw, F.lit(0.0)), sst + F.coalesce(msw, F.lit(0.0))), F.lit(0.0)))
    out = out.filter((F.col("levels") >= 2) & (F.col("levels") <= max_levels)).withColumns(
        {
            "eta2": F.coalesce(F.try_divide(F.col("ssb"), sst), F.lit(0.0)),
            "omega2": omega,
            "f": f,
            "dfb": dfb,
            "dfw": dfw,
            "spread": F.col("top.mean") - F.col("bottom.mean"),
            "noise_eta2": F.try_divide(dfb.cast("double"), F.col("n") - 1),
        }
    )
    p = F.when((F.col("ssw") == 0) & (F.col("ssb") == 0), F.lit(None)).otherwise(special.f_p(F.col("f"), F.col("dfb"), F.col("dfw")))
    kept = out.filter("apart is null or apart < 0.9").withColumn("p", p)
    return special.adjust(kept).withColumn("spread_pct", F.try_divide(F.col("spread") * 100.0, F.abs("overall"))).drop("apart")


def _by_level(df: DataFrame, categories: Sequence[str], values: Sequence[Column]) -> DataFrame:
    """``driver, level`` of every category in each row, with ``values``: one plan for all categories."""
    levels = F.array(*[F.struct(F.lit(c).alias("driver"), blank_key(F.col(f"`{c}`")).alias("level")) for c in categories])
    return df.select(*values, F.inline(levels))


def group_medians(df: DataFrame, categories: Sequence[str], metrics: Sequence[str], cuts: Mapping[str, Sequence[float]] | None = None, few: bool = False) -> DataFrame:
    """``driver, metric, level, median`` of the groups of :func:`group_moments`; ``cuts`` and ``few`` as in
    :func:`ranks.exact_quantiles`."""
    rows = _by_level(df, categories, [number(df, m).alias(f"m{j}") for j, m in enumerate(metrics)])
    got = medians(rows, {m: F.col(f"m{j}") for j, m in enumerate(metrics)}, ["driver", "level"], cuts, few)
    return got.select("driver", F.col("name").alias("metric"), "level", "median")


def driver_levels(moments: DataFrame, middle: DataFrame, min_group: int = 3) -> DataFrame:
    """The groups of each driver and metric with sd, median (of :func:`group_medians`)
    and lift over the mean of all kept rows."""
    pair = W.partitionBy("driver", "metric")
    grand = F.sum(F.col("n") * F.col("mean")).over(pair) / F.sum("n").over(pair)
    return (
        moments.filter(F.col("n") >= min_group)
        .withColumn("grand", grand)
        .join(middle, ["driver", "metric", "level"], "left")
        .select(
            "driver", "metric", "level", "n", "mean", "median", "sum", F.sqrt("var").alias("sd"),
            F.coalesce(F.try_divide((F.col("mean") - F.col("grand")) * 100.0, F.abs("grand")), F.lit(0.0)).alias("lift"),
        )
    )


# ------------------------------------------------------------ overlap


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """``a, b, n`` of rows with neither side blank."""
    x, y = trimmed(F.col(f"`{a}`")), trimmed(F.col(f"`{b}`"))
    return df.select(x.alias("a"), y.alias("b")).filter("a <> '' and b <> ''").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


#: Pairs of categories that one scan counts.
PAIRS = 60


def cramers_v(df: DataFrame, pairs: Sequence[tuple[str, str]], min_rows: int = 20, max_levels: int = 30, weight: str | None = None) -> DataFrame:
    """Association of category pairs with 2 to ``max_levels`` levels on both sides.

    The tables of all pairs come from one grouping for each :data:`PAIRS`.  Cells without rows count with
    their expectation.  p is given only where no expectation is below 1 and at most a
    fifth are below 5.  The sums run over counted cells and level totals, so no grid of
    levels is built: what empty cells add to chi-square is n less the expectations of the others.
    With ``weight`` each row stands for as many as that column says.
    """
    out = None
    for at in range(0, len(pairs), PAIRS):
        one = _associations(df, pairs[at : at + PAIRS], min_rows, max_levels, weight)
        out = one if out is None else out.unionByName(one)
    return special.adjust(out.withColumn("p", F.when(F.col("reliable"), special.chi2_p(F.col("chi2"), F.col("df")))))


def _associations(df: DataFrame, pairs: Sequence[tuple[str, str]], min_rows: int, max_levels: int, weight: str | None) -> DataFrame:
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    base = df.select((F.col(weight) if weight else F.lit(1)).alias("w"), *[trimmed(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(names)])
    sides = [F.struct(F.lit(k).alias("pair"), F.col(f"c{names.index(a)}").alias("x"), F.col(f"c{names.index(b)}").alias("y")) for k, (a, b) in enumerate(pairs)]
    cells = base.select("w", F.inline(F.array(*sides))).filter("x <> '' and y <> ''").groupBy("pair", "x", "y").agg(F.sum("w").alias("n"))

    def levels(side: str) -> DataFrame:
        return cells.select("pair", side).distinct().groupBy("pair").agg(F.count(F.lit(1)).alias(f"k{side}")).filter(F.col(f"k{side}").between(2, max_levels))

    usable = levels("x").join(levels("y"), "pair")  # a row for each pair
    # what is left of a pair is at most max_levels squared
    seen = cells.join(F.broadcast(usable), "pair").withColumns(
        {"rx": F.sum("n").over(W.partitionBy("pair", "x")), "cy": F.sum("n").over(W.partitionBy("pair", "y")), "total": F.sum("n").over(W.partitionBy("pair"))}
    )
    expected = F.col("rx") * F.col("cy") / F.col("total")
    filled = seen.groupBy("pair", "kx", "ky").agg(
        F.sum(F.pow(F.col("n") - expected, 2) / expected - expected).alias("part"), F.first("total").alias("n"),
        F.collect_set(F.struct("x", "rx")).alias("rows"), F.collect_set(F.struct("y", "cy")).alias("cols"),
    )
    grid = F.flatten(F.transform("rows", lambda r: F.transform("cols", lambda c: r["rx"] * c["cy"] / F.col("n"))))
    side = [F.element_at(F.array(*[F.lit(pair[i]) for pair in pairs]), F.col("pair") + 1) for i in (0, 1)]
    return (
        filled.filter(F.col("n") >= min_rows)
        .withColumn("grid", grid)
        .withColumn("chi2", F.greatest(F.lit(0.0), F.col("part") + F.col("n")))
        .select(
            side[0].alias("a"), side[1].alias("b"), "n", "chi2", ((F.col("kx") - 1) * (F.col("ky") - 1)).cast("int").alias("df"),
            F.least(F.lit(1.0), F.sqrt(F.col("chi2") / (F.col("n") * (F.least("kx", "ky") - 1)))).alias("v"),
            ((F.array_min("grid") >= 1) & (F.size(F.filter("grid", lambda e: e < 5)) <= 0.2 * F.size("grid"))).alias("reliable"),
        )
    )


# ------------------------------------------------------------ segments


def segment_scan(
    df: DataFrame, categories: Sequence[str], metric: str, cuts: Sequence[float] | None = None, few: bool = False, middle: bool = True, moments: DataFrame | None = None
) -> DataFrame:
    """Welch's test of each level against all other rows.

    The rest's moments are the whole less the level's, in central form, so
    nothing cancels.  Levels need 5 values and 1 % of the rows.  ``cuts`` (of the metric) and ``few``
    are as in :func:`ranks.exact_quantiles`; without ``middle`` medians are null and take no scan.
    ``moments`` of the categories and the metric, as of :func:`moments_of`, save the scan for means.
    """
    base = df.select(*[blank_key(F.col(f"`{c}`")).alias(c) for c in categories], number(df, metric).alias("_v"))
    levels = None if moments is not None and not middle else _by_level(base, categories, [F.col("_v")])
    if moments is not None:
        mine = moments.filter((F.col("metric") == metric) & F.col("driver").isin(list(categories))).withColumn("ss", F.col("var") * (F.col("n") - 1))
        # each row has one level of a category
        whole = _pooled(mine.filter(F.col("driver") == categories[0]), ["metric"]).select(*[F.col(c).alias(f"all_{c}") for c in ("n", "mean", "ss")], "rows")
        out = mine.select(F.col("driver").alias("column"), F.col("level").alias("value"), "n", "mean", "ss")
    else:
        whole = base.agg(F.count("_v").alias("all_n"), F.avg("_v").alias("all_mean"), (F.var_pop("_v") * F.count("_v")).alias("all_ss"), F.count(F.lit(1)).alias("rows"))
        out = levels.groupBy(F.col("driver").alias("column"), F.col("level").alias("value")).agg(
            F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.coalesce(F.var_pop("_v") * F.count("_v"), F.lit(0.0)).alias("ss")
        )
    if middle:
        cuts = cuts or cuts_of(base, {"_v": F.col("_v")})["_v"]  # before rows go to each of their levels
        found = medians(levels, {"_v": F.col("_v")}, ["driver", "level"], {"_v": cuts}, few)
        out = out.join(found.select(F.col("driver").alias("column"), F.col("level").alias("value"), "median"), ["column", "value"], "left")
    else:
        out = out.withColumn("median", F.lit(None).cast("double"))
    n1, n2 = F.col("n").cast("double"), (F.col("all_n") - F.col("n")).cast("double")
    m2 = F.try_divide(F.col("all_n") * F.col("all_mean") - n1 * F.col("mean"), n2)
    rest = F.greatest(F.lit(0.0), F.col("all_ss") - F.col("ss") - n1 * n2 / F.col("all_n") * F.pow(F.col("mean") - m2, 2))
    v1, v2 = F.col("ss") / (n1 - 1), F.col("rest_ss") / (n2 - 1)
    se2 = v1 / n1 + v2 / n2
    gap = F.col("mean") - F.col("rest_mean")
    t = F.when(se2 > 0, F.try_divide(gap, F.sqrt(se2))).when(gap > 0, F.lit(INF)).when(gap < 0, F.lit(-INF)).otherwise(0.0)
    dof = F.try_divide(se2 * se2, F.pow(v1 / n1, 2) / (n1 - 1) + F.pow(v2 / n2, 2) / (n2 - 1))
    scanned = (
        out.join(F.broadcast(whole))
        .filter((F.col("all_n") >= 20) & (F.col("n") >= F.greatest(F.lit(5), F.ceil(F.col("rows") * 0.01))) & (F.col("all_n") - F.col("n") >= 2))
        .withColumn("rest_mean", m2)
        .withColumn("rest_ss", rest)
        .withColumn("t", t)
        .withColumn("dof", F.when(se2 > 0, dof))
    )
    p = F.when(F.abs("t") == INF, 0.0).when(F.col("dof").isNull(), 1.0).otherwise(special.student_p(F.col("t"), F.col("dof")))
    return special.adjust(scanned.withColumn("p", p)).select(
        "column", "value", "n", "mean", "median", "rest_mean", "t", "dof", "p", "p_adj",
        F.coalesce(F.try_divide((F.col("mean") - F.col("all_mean")) * 100.0, F.abs("all_mean")), F.lit(0.0)).alias("lift"),
        (F.col("n") * 100.0 / F.col("all_n")).alias("share"),
    )


def hot_and_cold(segments: DataFrame, most: int = 12) -> DataFrame:
    """The ``most`` segments above and below the mean each, by falling |t|: ``side, place`` first."""
    side = F.when(F.col("lift") > 0, "above").when(F.col("lift") < 0, "below")
    order = W.partitionBy("side").orderBy(F.desc(F.abs("t")), "column", "value")  # one row per level
    placed = segments.withColumn("side", side).filter("side is not null").withColumn("place", F.row_number().over(order))
    return placed.filter(F.col("place") <= most).select("side", "place", *segments.columns)


# ------------------------------------------------------------ bins


def all_bin_edges(df: DataFrame, columns: Sequence[str], bins: int = 5, chunk: int = 8) -> dict[str, list[float]]:
    """Distinct quantile edges of each column that has 20 values and three edges or more."""
    at = FIFTHS if bins == 5 else [i / bins for i in range(bins + 1)]
    out = {}
    for k in range(0, len(columns), chunk):
        part = columns[k : k + chunk]
        for row in exact_quantiles(df, {c: number(df, c) for c in part}, at).collect():  # one row per column
            if edges := usable_edges(row["n"], row["q"]):
                out[row["name"]] = edges
    return out


def usable_edges(n: int, quantiles: Sequence[float]) -> list[float]:
    """Distinct edges; none of fewer than 20 values or three edges."""
    edges = sorted(set(quantiles or ()))
    return edges if n >= 20 and len(edges) >= 3 else []


def bin_edges(df: DataFrame, column: str, bins: int = 5) -> list[float]:
    """Edges of one column; empty where there are too few."""
    return all_bin_edges(df, [column], bins).get(column, [])


def bin_label(value: Column, edges: Sequence[float]) -> Column:
    """``lo – hi`` of the first bin whose upper edge is not below the value."""
    out = None
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        label = F.concat(fmt_num(F.lit(lo)), F.lit(" – "), fmt_num(F.lit(hi)))
        out = F.when(value <= F.lit(hi), label) if out is None else out.when(value <= F.lit(hi), label)
    return F.when(value.isNotNull(), out)


def with_quintiles(df: DataFrame, columns: Sequence[str], most: int | None = None, edges: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """Adds bands of the columns that can be binned, of the first ``most`` such columns; ``edges``
    are those of :func:`all_bin_edges`, looked for unless given."""
    if edges is None:
        edges = all_bin_edges(df, columns) if columns else {}
    binned = [c for c in columns if edges.get(c)][:most]
    return df.withColumns({f"{c} (quintile)": bin_label(number(df, c), edges[c]) for c in binned}) if binned else df


# ------------------------------------------------------------ outliers


def _spreads(df: DataFrame, x: Mapping[str, Column]) -> dict[str, dict]:
    """n, mean, sd, q1, median and q3 of each named number."""
    columns = list(x)
    moments = df.agg(*[F.struct(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd")).alias(f"s{i}") for i, v in enumerate(x.values())]).first()
    out = {c: moments[f"s{i}"].asDict() for i, c in enumerate(columns)}
    for k in range(0, len(columns), 8):
        for r in exact_quantiles(df, {c: x[c] for c in columns[k : k + 8]}, (0.25, 0.5, 0.75)).collect():
            out[r["name"]] |= dict(zip(("q1", "median", "q3"), r["q"], strict=True))
    return out


def outliers(df: DataFrame, columns: Sequence[str], row: str, z: float = 3.0, profiles: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Cells at least ``z`` deviations out, or outside the quartile fences and two out.

    Columns need more than 12 values and spread.  Their moments and quartiles, one
    row for each column, come first (from ``profiles`` where given, with n, mean, sd, q1, median
    and q3 of each column); then one scan finds the cells of all.
    """
    x = {c: number(df, c) for c in columns}
    known = profiles or _spreads(df, x)
    cells = []
    for c in columns:
        s = known[c]
        if s["n"] > 12 and s["sd"]:
            low, mid, high = s["q1"], s["median"], s["q3"]
            score = (x[c] - F.lit(s["mean"])) / F.lit(s["sd"])
            fenced = (x[c] < low - 1.5 * (high - low)) | (x[c] > high + 1.5 * (high - low))
            cells.append(F.struct(F.lit(c).alias("column"), x[c].alias("value"), score.alias("z"), F.lit(float(mid)).alias("expected"), fenced.alias("fenced")))
    if not cells:
        cells = [F.struct(*[F.lit(None).cast(t).alias(c) for c, t in (("column", "string"), ("value", "double"), ("z", "double"), ("expected", "double"), ("fenced", "boolean"))])]
    far = F.abs("z")
    return (
        df.select(F.col(row).alias("row"), F.inline(F.array(*cells)))
        .filter((far >= z) | (F.col("fenced") & (far >= 2)))
        .select(
            "column", "row", "value", "z", "expected", F.when(far >= z, "z-score").otherwise("iqr").alias("method"),
            F.when(far >= 4, "high").when(far >= 3, "medium").otherwise("low").alias("severity"), F.when(F.col("z") > 0, "above").otherwise("below").alias("direction"),
        )
    )


def rare_categories(df: DataFrame, column: str, most: int = 5) -> DataFrame:
    """Up to ``most`` values that occur once, where over 50 cells are filled."""
    counts = key_counts(df, column)
    filled = counts.agg(F.sum("n").alias("filled")).filter("filled > 50")
    return counts.filter("n = 1").join(F.broadcast(filled)).orderBy("key").limit(most).select(F.lit(column).alias("column"), F.col("key").alias("value"))


