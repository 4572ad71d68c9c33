"""Column profiles: moments, exact quantiles, value counts, histograms, quality parts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascry.functions.values import finite, is_blank, parse_date, parse_number, trimmed
from datascry.operators.ranks import exact_quantiles


def number(df: DataFrame, name: str) -> Column:
    """The column as finite doubles; text cells are parsed."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.StringType):
        return parse_number(c)
    return finite(c)


def instant(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return parse_date(c) if isinstance(df.schema[name].dataType, T.StringType) else c.cast("timestamp")


def blank(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    return is_blank(c) if isinstance(df.schema[name].dataType, T.StringType) else c.isNull()


def g1(x: Column, n: Column) -> Column:
    """Adjusted Fisher-Pearson skewness; 0 below three values or without spread."""
    n = n.cast("double")
    raw = F.skewness(x) * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when((n < 3) | (F.coalesce(F.stddev_samp(x), F.lit(0.0)) == 0), 0.0).otherwise(raw)


def kurt(x: Column, n: Column) -> Column:
    """Excess kurtosis with the sample deviation; 0 below four values or without spread."""
    n = n.cast("double")
    raw = (F.kurtosis(x) + 3.0) * F.pow(F.try_divide(n - 1, n), 2) - 3.0
    return F.when((n < 4) | (F.coalesce(F.stddev_samp(x), F.lit(0.0)) == 0), 0.0).otherwise(raw)


#: Ranks that bands of a fifth of the values end at.
FIFTHS = tuple(i / 5 for i in range(6))


def numeric_profile(df: DataFrame, columns: Sequence[str], report: bool = False) -> DataFrame:
    """One row per column.

    Unparseable cells are neither missing nor values; quantiles are exact.  Moments come from one
    grouping of cells under their column's number: an aggregate of all columns side by
    side is a method so long that the JVM never compiles it.  For a ``report`` distinct values are
    not counted, and the quantiles at :data:`FIFTHS` come along as ``fifths``.
    """
    x, n = F.col("c.v"), F.count("c.v")
    mean, sd = F.avg(x), F.coalesce(F.stddev_samp(x), F.lit(0.0))
    total, missing = F.count(F.lit(1)), F.count_if("c.b")
    cells = _cells(df, columns, lambda c: F.struct(number(df, c).alias("v"), blank(df, c).alias("b"))).withColumnRenamed("v", "c")
    found = cells.groupBy("i").agg(
        total.alias("total"),
        missing.alias("missing"),
        F.coalesce(F.try_divide(missing * 100.0, total), F.lit(0.0)).alias("missing_pct"),
        n.alias("n"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        mean.alias("mean"),
        F.sum(x).alias("sum"),
        sd.alias("sd"),
        F.when(mean == 0, 0.0).otherwise(F.abs(F.try_divide(sd, mean))).alias("cv"),
        g1(x, n).alias("skew"),
        kurt(x, n).alias("kurtosis"),
        F.count_if(x == 0).alias("zeros"),
        F.count_if(x < 0).alias("negatives"),
    )
    every = df.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("i"))
    none = ["total", "missing", "missing_pct", "n", "sd", "skew", "kurtosis", "zeros", "negatives"]
    out = _named(every.join(F.broadcast(found), "i", "left").fillna(0, none).withColumn("position", F.col("i")), columns)
    at = (0.05, 0.25, 0.5, 0.75, 0.95)
    q = exact_quantiles(df, {c: number(df, c) for c in columns}, (*at, *FIFTHS) if report else at).select(
        F.col("name").alias("column"), *[F.col("q")[i].alias(name) for i, name in enumerate(("p05", "q1", "median", "q3", "p95"))],
        *([F.slice("q", len(at) + 1, len(FIFTHS)).alias("fifths")] if report else []),
    )
    if not report:
        out = out.join(F.broadcast(distinct_numbers(df, columns)), "column", "left").fillna(0, ["distinct"])
    # those joined have one row per column
    got = out.join(F.broadcast(q), "column", "left").withColumn("iqr", F.col("q3") - F.col("q1"))
    return got.select("column", "position", *[c for c in got.columns if c not in ("column", "position")])


def distinct_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, distinct``: different numbers of all columns by one grouping; no row for a column without any."""
    values = _cells(df, columns, lambda c: number(df, c)).filter("v is not null").groupBy("i", "v").agg(F.lit(1))
    return _named(values.groupBy("i").agg(F.count(F.lit(1)).alias("distinct")), columns)


def quantiles(df: DataFrame, column: str, at: Sequence[float]) -> DataFrame:
    """Exact quantiles by linear interpolation: ``q, value``; nulls where there is no value."""
    asked = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(float(q)) for q in at])).alias("i", "q"))
    got = exact_quantiles(df, {column: number(df, column)}, at).select(F.posexplode("q").alias("i", "value"))
    return asked.join(got, "i", "left").select("q", "value")


def histogram(df: DataFrame, column: str, bins: int = 24) -> DataFrame:
    """Equal-width bins ``bin, lo, hi, n``, empty ones too; a constant column has one."""
    values = df.select(number(df, column).alias("v")).filter("v is not null")
    span = values.agg(F.min("v").alias("least"), F.max("v").alias("most")).filter("least is not null")
    width = (F.col("most") - F.col("least")) / F.lit(float(bins))
    bin_of = F.when(F.col("most") == F.col("least"), 0).otherwise(
        F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("v") - F.col("least"), width)).cast("int"))
    )
    counts = values.join(F.broadcast(span)).groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    last = F.when(F.col("most") == F.col("least"), 0).otherwise(bins - 1)
    spine = span.select("least", width.alias("w"), F.explode(F.sequence(F.lit(0), last)).alias("bin"))
    return spine.join(counts, "bin", "left").select(
        "bin",
        (F.col("least") + F.col("bin") * F.col("w")).alias("lo"),
        (F.col("least") + (F.col("bin") + 1) * F.col("w")).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def key_counts(df: DataFrame, column: str) -> DataFrame:
    """``key, n`` of the trimmed non-blank cells."""
    return df.select(trimmed(F.col(f"`{column}`")).alias("key")).filter("key <> ''").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, column: str, top: int = 12) -> DataFrame:
    """The ``top`` most frequent cells with their share; ties by key."""
    counts = key_counts(df, column)
    total = counts.agg(F.sum("n").alias("total"))
    return (
        counts.orderBy(F.desc("n"), "key").limit(top).join(F.broadcast(total)).select("key", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))
    )


def _cells(df: DataFrame, columns: Sequence[str], value: Callable[[str], Column]) -> DataFrame:
    """``i, v``: each row's values of all columns under their numbers, for one grouping of all."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), value(c).alias("v")) for i, c in enumerate(columns)])))


def _named(by_number: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column`` in place of its number ``i``."""
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1)
    return by_number.select(name.alias("column"), *[c for c in by_number.columns if c != "i"])


def all_key_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``i, key, n``: :func:`key_counts` of all columns by one grouping; ``i`` is a column's place."""
    keys = _cells(df, columns, lambda c: trimmed(F.col(f"`{c}`"))).filter("v <> ''")
    return keys.groupBy("i", F.col("v").alias("key")).agg(F.count(F.lit(1)).alias("n"))


def concentrations(df: DataFrame, columns: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """A row for each column: distinct, singletons, HHI, top share, entropy in bits, balance.

    A column without filled cells has zeros and nulls.  ``counts`` are those of :func:`all_key_counts`, counted unless given."""
    counts = counts or all_key_counts(df, columns)
    total = counts.groupBy("i").agg(F.sum("n").alias("total"))  # a row for each column
    p = F.col("n") / F.col("total")
    k = F.count(F.lit(1))
    most = F.log2(F.greatest(F.lit(2.0), k.cast("double")))
    entropy = -F.sum(p * F.log2(p))
    found = counts.join(F.broadcast(total), "i").groupBy("i").agg(
        k.alias("distinct"),
        F.count_if(F.col("n") == 1).alias("singletons"),
        F.sum(p * p).alias("hhi"),
        (F.max(p) * 100.0).alias("top_share"),
        entropy.alias("entropy"),
        most.alias("max_entropy"),
        (entropy / most).alias("balance"),
    )
    every = df.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("i"))
    return _named(every.join(F.broadcast(found), "i", "left").fillna(0, ["distinct", "singletons"]).fillna(1.0, ["max_entropy"]), columns)


def concentration(df: DataFrame, column: str) -> DataFrame:
    """:func:`concentrations` of one column."""
    return concentrations(df, [column])


def top_values(df: DataFrame, columns: Sequence[str], top: int = 12, counts: DataFrame | None = None) -> DataFrame:
    """``column, place, key, n, pct``: :func:`value_counts` of all columns; ``counts`` as in :func:`concentrations`."""
    counts = counts or all_key_counts(df, columns)
    total = counts.groupBy("i").agg(F.sum("n").alias("total"))  # a row for each column
    place = F.row_number().over(W.partitionBy("i").orderBy(F.desc("n"), "key"))  # Spark keeps only the first of each task
    shown = counts.withColumn("place", place).filter(F.col("place") <= top).join(F.broadcast(total), "i")
    return _named(shown.select("i", "place", "key", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct")), columns)


def missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, total, missing, missing_pct, complete``, one scan for all columns."""
    names = list(columns or df.columns)
    total = F.count(F.lit(1))
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            total.alias("total"),
            F.count_if(blank(df, c)).alias("missing"),
            F.coalesce(F.try_divide(F.count_if(blank(df, c)) * 100.0, total), F.lit(0.0)).alias("missing_pct"),
            (total - F.count_if(blank(df, c))).alias("complete"),
        )
        for c in names
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """:func:`missingness` with ``unique`` (distinct trimmed cells that are filled),
    ``unique_pct`` of the filled cells, and ``constant``."""
    names = list(columns or df.columns)
    counted = _named(all_key_counts(df, names).groupBy("i").agg(F.count(F.lit(1)).alias("unique")), names)
    share = F.coalesce(F.try_divide(F.col("unique") * 100.0, F.col("complete")), F.lit(0.0))
    return missingness(df, names).join(F.broadcast(counted), "column", "left").fillna(0, ["unique"]).withColumn("unique_pct", share).withColumn("constant", F.col("unique") <= 1)


def date_profile(df: DataFrame, column: str) -> DataFrame:
    at = instant(df, column)
    span = (F.unix_micros(F.max("t")) - F.unix_micros(F.min("t"))) / 86_400_000_000
    return (
        df.select(at.alias("t"), blank(df, column).alias("b"))
        .agg(
            F.lit(column).alias("column"),
            F.count(F.lit(1)).alias("total"),
            F.count_if("b").alias("missing"),
            F.count("t").alias("n"),
            F.count_distinct("t").alias("distinct"),
            F.min("t").alias("first"),
            F.max("t").alias("last"),
            F.round(span).cast("long").alias("span_days"),
        )
    )


def case_variants(df: DataFrame, columns: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """``column, variants``: lower-cased keys that have more than one spelling; ``counts`` as in :func:`concentrations`."""
    spelled = (counts or all_key_counts(df, columns)).groupBy("i", F.lower("key").alias("k")).agg(F.count(F.lit(1)).alias("spellings"))
    found = spelled.groupBy("i").agg(F.count_if(F.col("spellings") > 1).alias("variants"))
    every = df.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("i"))
    return _named(every.join(F.broadcast(found), "i", "left").fillna(0, ["variants"]), columns)


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``duplicates``: rows equal to an earlier one in all columns."""
    names = [f"`{c}`" for c in columns or df.columns]
    # rows that agree meet by a hash of themselves; the values decide
    return df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def noise_floor(n: Column, groups: int = 3) -> list[Column]:
    """Sizes of r, eta squared and V that chance alone reaches at n rows."""
    d = n.cast("double")
    return [
        F.try_divide(F.lit(1.96), F.sqrt(d - 3)).alias("r"),
        F.try_divide(F.lit(float(groups - 1)), d - 1).alias("eta2"),
        F.try_divide(F.lit(1.96), F.sqrt(d)).alias("v"),
    ]


def quality_issues(df: DataFrame, profiles: DataFrame, duplicates: int) -> DataFrame:
    """Issues from ``profiles`` (``column, type, missing_pct, constant, skew,
    variants``): ``column, issue, severity, penalty``."""
    m = F.col("missing_pct")

    def issue(when: Column, name: str, severity: str, penalty: float) -> Column:
        return F.when(when, F.struct(F.col("column"), F.lit(name).alias("issue"), F.lit(severity).alias("severity"), F.lit(penalty).alias("penalty")))

    found = F.array(
        issue(m > 50, "mostly missing", "high", 6.0),
        issue((m > 15) & (m <= 50), "often missing", "medium", 3.0),
        issue((m > 0) & (m <= 15), "some missing", "low", 0.5),
        issue(F.col("constant"), "constant", "medium", 2.0),
        issue(F.col("type") == "id", "identifier", "low", 0.0),
        issue(F.abs("skew") > 2, "skewed", "low", 0.0),
        issue(F.col("variants") > 0, "case variants", "medium", 1.5),
    )
    issues = profiles.select(F.inline(F.filter(found, lambda x: x.isNotNull())))
    if duplicates:
        spark = df.sparkSession
        dup = spark.range(1).select(
            F.lit("(rows)").alias("column"), F.lit("duplicate rows").alias("issue"), F.lit("medium").alias("severity"), F.lit(min(10.0, 0.5 * duplicates)).alias("penalty")
        )
        issues = issues.unionByName(dup)
    return issues


def quality_score(issues: DataFrame) -> DataFrame:
    """``score``: 100 less all penalties, rounded, at least 0; and issue counts."""
    return issues.agg(
        F.greatest(F.lit(0.0), F.round(100.0 - F.coalesce(F.sum("penalty"), F.lit(0.0)))).cast("long").alias("score"),
        F.count(F.lit(1)).alias("issues"),
        F.count_if(F.col("severity") == "high").alias("severe"),
    )


def ranked(df: DataFrame, by: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """Adds ``_pos``, the place in the order ``by``."""
    w = W.partitionBy(*partition) if partition else W.partitionBy(F.lit(0))
    return df.withColumn("_pos", F.row_number().over(w.orderBy(*by)))
