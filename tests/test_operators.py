"""Exact unit facts and edge cases of the table statistics."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from datascry.functions import special, values
from datascry.operators import explore, profile, ranks, relations, series
from datascry.plans import display, naming


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(df):
    return df.first().asDict()


def test_benjamini_hochberg(spark):
    df = frame(spark, [(0.01,), (0.04,), (0.03,), (0.2,), (None,), (float("nan"),)], "p double")
    got = sorted((r.p, r.p_adj) for r in special.adjust(df).filter("p is not null and not isnan(p)").collect())
    assert [q for _, q in got] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.2])
    assert special.adjust(df).filter("p_adj is null").count() == 2


def test_tails(spark):
    t = frame(spark, [(0.0, 3.0, 1.0), (2.0, 10.0, 0.07338803477074052), (float("inf"), 4.0, 0.0), (1.96, 1e5, 0.0499985631950)], "t double, df double, p double")
    for r in t.select("p", special.student_p(F.col("t"), F.col("df")).alias("got")).collect():
        assert r.got == pytest.approx(r.p, abs=1e-9)
    f = frame(spark, [(1.0, 100), (3.5, 12), (0.2, 9)], "f double, d int")
    for r in f.select("f", "d", special.f_p(F.col("f"), F.lit(2), F.col("d")).alias("got")).collect():
        assert r.got == pytest.approx((1 + 2 * r.f / r.d) ** (-r.d / 2), rel=1e-10)
    c = frame(spark, [(2.0, 2), (10.0, 4), (100.0, 80)], "x double, k int")
    for r in c.select("x", "k", special.chi2_p(F.col("x"), F.col("k")).alias("got")).collect():
        h = r.x / 2
        assert r.got == pytest.approx(math.exp(-h) * sum(h**i / math.factorial(i) for i in range(r.k // 2)), rel=1e-10)


@pytest.mark.parametrize(
    ("cell", "number"),
    [("(1,234.5)", -1234.5), ("$", None), ("-", None), ("-5%", -5.0), ("1d", None), ("NaN", None), ("Infinity", None), (" 12 ", 12.0), ("(-5)", -5.0), ("0x1F", None), ("1e3", 1000.0), ("1,2,3", 123.0), ("", None), (None, None)],
)
def test_parse_number(spark, cell, number):
    assert one(frame(spark, [(cell,)], "s string").select(values.parse_number(F.col("s")).alias("n")))["n"] == number


@pytest.mark.parametrize(
    ("cell", "day"),
    [("2024-02-29", "2024-02-29"), ("2023-02-29", None), ("2024-13-01", None), ("02/30/2024", None), ("0001-01-01", "0001-01-01"), ("1/2/99", "1999-01-02"), ("3-Jan-2024", "2024-01-03"), ("Feb 30, 2024", "2024-03-01"), ("Foo 3 2024", None), ("2024-01-02T23:30:00-02:00", "2024-01-03"), (None, None)],
)
def test_parse_date(spark, cell, day):
    got = frame(spark, [(cell,)], "s string").select(F.date_format(values.parse_date(F.col("s")), "yyyy-MM-dd").alias("d"))
    assert one(got)["d"] == day


def test_variance_extremes(spark):
    rows = [("a", 1.0, 2.0)] * 3 + [("b", 2.0, 2.0)] * 3
    df = frame(spark, rows, "k string, x double, y double")
    m = relations.group_moments(df, ["k"], ["x", "y"])
    # groups that do not overlap restate the metric; equal values leave no F
    assert relations.driver_effects(m).filter("metric = 'x'").count() == 0
    overlapping = m.withColumn("lo", F.lit(0.0)).withColumn("hi", F.lit(9.0))
    x = one(relations.driver_effects(overlapping).filter("metric = 'x'"))
    assert (x["eta2"], x["omega2"], x["f"], x["p"]) == (1.0, 1.0, float("inf"), 0.0)
    y = one(relations.driver_effects(overlapping).filter("metric = 'y'"))
    assert (y["eta2"], y["f"], y["p"]) == (0.0, 0.0, None)


def test_noise_of_many_groups_is_not_kept(spark):
    import random

    rng = random.Random(4)
    df = frame(spark, [(f"g{i % 39}", rng.random()) for i in range(312)], "k string, v double")
    got = one(relations.driver_effects(relations.group_moments(df, ["k"], ["v"])))
    assert got["eta2"] > 0.05 and got["p_adj"] >= 0.05


def test_cramers_v_reliability(spark):
    sparse = [("a", "x")] * 100 + [("b", "y")]
    balanced = [(a, b) for a in "ab" for b in "xy"] * 10
    got = one(relations.cramers_v(frame(spark, sparse, "a string, b string"), [("a", "b")]))
    assert not got["reliable"] and got["p"] is None
    got = one(relations.cramers_v(frame(spark, balanced, "a string, b string"), [("a", "b")]))
    assert got["reliable"] and got["p"] == 1.0 and got["v"] == 0.0


def test_welch(spark):
    rows = [("treated", 10.0 + i % 5) for i in range(100)] + [("control", 5.0 + i % 5) for i in range(200)]
    got = one(relations.segment_scan(frame(spark, rows, "g string, v double"), ["g"], "v").filter("value = 'treated'"))
    assert got["t"] > 10 and got["p_adj"] < 0.05 and got["n"] == 100
    flat = frame(spark, [("a", 1.0)] * 20 + [("b", 2.0)] * 20 + [("c", 1.5)] * 20, "g string, v double")
    scanned = {r.value: r for r in relations.segment_scan(flat.filter("g <> 'c'"), ["g"], "v").collect()}
    assert scanned["a"].t == -math.inf and scanned["a"].p == 0.0


def test_moments_of_tiny_columns(spark):
    df = frame(spark, [(1.0, None), (None, None)], "x double, y double")
    got = {r.column: r for r in profile.numeric_profile(df, ["x", "y"]).collect()}
    assert (got["x"].n, got["x"].sd, got["x"].skew, got["x"].kurtosis, got["x"].missing) == (1, 0.0, 0.0, 0.0, 1)
    assert got["y"].n == 0 and got["y"].mean is None
    assert [r.n for r in profile.histogram(df, "x").collect()] == [1]
    assert profile.histogram(df, "y").count() == 0
    assert profile.missingness(df.limit(0)).count() == 2


def test_duplicates_variants_counts(spark):
    df = frame(spark, [("A",), ("a ",), ("a",), (None,), (" ",), ("b",), ("b",)], "k string")
    assert one(profile.duplicate_rows(df))["duplicates"] == 1
    assert one(profile.case_variants(df, ["k"]))["variants"] == 1
    assert [(r.key, r.n) for r in profile.value_counts(df, "k").collect()] == [("a", 2), ("b", 2), ("A", 1)]


def test_spearman_deletes_pairwise(spark):
    rows = [(1.0, 10.0, 3.0), (2.0, None, 1.0), (3.0, 30.0, 2.0), (4.0, 20.0, 2.0), (None, 5.0, 9.0)]
    got = {(r.a, r.b): r.rho for r in relations.spearman_pairs(frame(spark, rows, "x double, y double, z double"), ["x", "y", "z"]).collect()}
    assert got["x", "y"] == pytest.approx(0.5)
    assert got["x", "z"] == pytest.approx(-0.3162277660168379)


@pytest.mark.parametrize(("days", "weekdays", "months"), [(21, 0, 0), (56, 0, 0), (57, 7, 0), (800, 7, 12)])
def test_seasonality_needs_coverage(spark, days, weekdays, months):
    s = spark.range(days).select(F.date_add(F.lit("2022-01-01"), F.col("id").cast("int")).alias("day"), (F.col("id") % 7 + 1.0).alias("value"), F.lit(1).alias("n"))
    assert series.weekday_seasonality(s).count() == weekdays
    assert series.month_seasonality(s).count() == months


def test_partial_days_are_trimmed(spark):
    rows = [(i, 10 if i < 12 else 1) for i in range(15)]
    s = frame(spark, rows, "i int, n long").select(F.date_add(F.lit("2024-01-01"), F.col("i")).alias("day"), F.lit(1.0).alias("value"), "n")
    assert series.trim_partial(s).count() == 12
    assert series.forecast(s.limit(3)).count() == 0


def test_quintiles_and_deciles(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("v"))
    assert relations.bin_edges(df, "v") == pytest.approx([0, 19.8, 39.6, 59.4, 79.2, 99])
    assert relations.bin_edges(df.limit(10), "v") == []
    assert relations.with_quintiles(df, ["v"]).select("v (quintile)").distinct().count() == 5
    got = {r.decile: (r.n, r.sum) for r in explore.decile_share(df.filter("v < 23"), "v").collect()}
    values_ = list(range(23))
    assert got == {d + 1: (len(x), float(sum(x))) for d in range(10) if (x := values_[d * 23 // 10 : (d + 1) * 23 // 10])}


def test_pareto_and_crosstab_blanks(spark):
    df = frame(spark, [("a", "x", 8.0), ("b", "x", None), (None, "y", 1.0), (" ", "y", 1.0)], "k string, c string, v double")
    items = {r.key: (r.value, r.place) for r in explore.pareto(df, "k", "v").collect()}
    # a key without any number is no item
    assert items == {"a": (8.0, 1), "(blank)": (2.0, 2)}
    assert one(explore.pareto_summary(explore.pareto(df, "k", "v")))["count_to_80"] == 1
    cells = {(r.r, r.c): r.value for r in explore.crosstab(df, "k", "c", "v", "mean").collect()}
    assert cells == {("a", "x"): 8.0, ("b", "x"): None, ("(blank)", "y"): 1.0}


def test_exact_quantiles(spark):
    """Against numpy: hot values, gaps, few values, groups that are null."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [("a", float(x), None) for x in rng.normal(size=30_000)] + [("a", 0.0, None)] * 20_000
    rows += [("b", float(x), float(x) if x % 3 else None) for x in range(7)] + [(None, 5.0, 2.0), ("c", None, None)]
    df = frame(spark, rows, "k string, x double, y double").repartition(7)
    at = (0.0, 0.05, 0.25, 0.5, 0.77, 0.95, 1.0)
    got = {(r.k, r.name): (r.n, r.q) for r in ranks.exact_quantiles(df, {"x": F.col("x"), "y": F.col("y")}, at, ["k"]).collect()}
    assert set(got) == {("a", "x"), ("b", "x"), ("b", "y"), (None, "x"), (None, "y")}
    for (k, name), (n, q) in got.items():
        values_ = [r[1 if name == "x" else 2] for r in rows if r[0] == k and r[1 if name == "x" else 2] is not None]
        assert n == len(values_) and q == pytest.approx(np.quantile(values_, at).tolist(), abs=1e-12)
    whole = ranks.exact_quantiles(df, {"x": F.col("x")}, (0.3, 0.6)).first()
    assert whole.q == pytest.approx(np.quantile([r[1] for r in rows if r[1] is not None], (0.3, 0.6)).tolist(), abs=1e-12)
    assert ranks.exact_quantiles(df.limit(0), {"x": F.col("x")}, (0.5,)).count() == 0


def test_value_ranks(spark):
    rows = [(float(x % 97) if x % 5 else 0.0,) for x in range(3000)]
    got = {r.v: r.rank for r in ranks.value_ranks(frame(spark, rows, "v double"), "v").collect()}
    flat = sorted(r[0] for r in rows)
    assert got == {v: sum(i + 1 for i, x in enumerate(flat) if x == v) / flat.count(v) for v in set(flat)}


@pytest.mark.parametrize("sizes", [range(0, 60), (61, 137, 262, 400, 933, 3300, 3333, 3334, 3400), (9_999, 10_000, 10_001, 20_011)])
def test_quantiles_of_all_sizes(spark, sizes):
    """Every group at 41 places, asked for in any order, against linear interpolation."""
    at = [i / 40 for i in reversed(range(41))]
    rng = random.Random(len(sizes))
    rows = [(n, float(i * i) if n % 3 else float(rng.randrange(7))) for n in sizes for i in range(n)] + [(n, None) for n in sizes]
    df = frame(spark, rows, "k int, x double")
    got = {r.k: (r.n, r.q) for r in ranks.exact_quantiles(df, {"x": F.col("x")}, at, ["k"]).collect()}
    assert set(got) == {n for n in sizes if n}
    for n, (count, q) in got.items():
        assert count == n and q == pytest.approx(np.quantile([x for k, x in rows if k == n and x is not None], at).tolist(), rel=1e-10, abs=1e-9), n


def test_ranks_of_hot_and_of_many_values(spark, monkeypatch):
    rows = [(float(x % 911) if x % 3 else 0.0, float(x) if x % 2 else 7.5, None if x % 4 else 1.0) for x in range(4000)]
    df = frame(spark, rows, "x double, y double, z double")
    flat = [sorted(r[i] for r in rows if r[i] is not None) for i in range(3)]
    want = [{v: sum(i + 1 for i, u in enumerate(col) if u == v) / col.count(v) for v in set(col)} for col in flat]
    for few in (100_000, 10):
        monkeypatch.setattr(ranks, "FEW_VALUES", few)
        monkeypatch.setattr(ranks, "MOST_HOT", 10)
        got = ranks.with_ranks(df, ["x", "y", "z"], ["a", "b", "c"])
        assert got.columns == ["x", "y", "z", "a", "b", "c"] and got.count() == len(rows)
        for r in got.collect():
            assert (r.a, r.b, r.c) == tuple(w.get(v) for w, v in zip(want, (r.x, r.y, r.z)))


@pytest.mark.parametrize("cuts", [[], [0.0], [-3.0, 0.0, 5e-324, 2.0, 2.0, 7.5], [1e9, float("inf")], [float(i) for i in range(400)]])
def test_any_cuts_give_the_same_ranks_medians_and_deciles(spark, monkeypatch, cuts):
    """Cuts decide where rows go, nothing else; both zeros are one value."""
    rng = random.Random(4)
    rows = [(rng.choice("abc") if i % 50 else None, rng.choice([0.0, -0.0, 7.5, None, float(rng.randrange(-200, 400)), rng.random()])) for i in range(3000)]
    df = frame(spark, rows, "k string, x double").repartition(3)
    flat = sorted(x for _, x in rows if x is not None)
    places = {}
    for i, x in enumerate(flat):
        places.setdefault(x, []).append(i + 1)
    monkeypatch.setattr(ranks, "FEW_VALUES", 10)
    got = ranks.with_ranks(df, ["x"], ["r"], {"x": cuts}).collect()
    assert len(got) == len(rows) and all(r.r == (None if r.x is None else sum(places[r.x]) / len(places[r.x])) for r in got)
    at = (0.9, 0.0, 0.25, 0.5, 1.0)
    for few in (True, False):
        got = {r.k: (r.n, r.q) for r in ranks.exact_quantiles(df, {"x": F.col("x")}, at, ["k"], {"x": cuts}, few).collect()}
        assert set(got) == {"a", "b", "c", None}
        for k, (n, q) in got.items():
            mine = [x for c, x in rows if c == k and x is not None]
            assert n == len(mine) and q == pytest.approx(np.quantile(mine, at).tolist(), abs=1e-12)
    got = {r.decile: (r.n, r.sum) for r in explore.decile_share(df, "x", cuts).collect()}
    n = len(flat)
    for d in range(10):
        part = flat[d * n // 10 : (d + 1) * n // 10]
        assert got[d + 1] == (len(part), pytest.approx(sum(part), abs=1e-9))


def test_ranks_move_rows_without_joining_them_to_a_table_of_values(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FEW_VALUES", 10)
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 1.5).otherwise(F.col("id").cast("double")).alias("x"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ranks.with_ranks(df, ["x"], ["r"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_pareto_of_equal_sums_is_in_many_ranges(spark):
    keys = spark.range(50_000).select(F.concat(F.lit("Customer#"), F.format_string("%09d", F.col("id"))).alias("key"), F.lit(1.0).alias("value"))
    assert ranks.in_pair_ranges(keys, "value", "key").select("range").distinct().count() > 100
    got = explore.pareto(keys, "key", "value")
    top = got.orderBy("place").limit(3).collect()
    assert [r["key"][-1] for r in top] == ["0", "1", "2"] and got.filter("place = 40000").first()["cum_share"] == pytest.approx(80)
    mixed = frame(spark, [("b", 3.0), ("a", 3.0), ("c", -1.0), (None, 5.0), ("d", None), ("a", 0.0)], "k string, v double")
    assert [(r["key"], r["value"]) for r in explore.pareto(mixed, "k", "v").orderBy("place").collect()] == [("(blank)", 5.0), ("a", 3.0), ("b", 3.0), ("c", -1.0)]


def test_axis_ticks():
    assert display.axis_ticks(0, 10) == [0, 5, 10]
    assert display.axis_ticks(0, 100, 4) == [0, 50, 100]
    assert display.axis_ticks(-1, 1) == [-1, -0.5, 0, 0.5, 1]
    assert display.axis_ticks(3, 3) == [2, 2.5, 3, 3.5, 4]
    assert display.axis_ticks(float("nan"), 1) == [0, 1]


def test_names():
    assert naming.detect_domain(["Annual Premium", "Policy ID", "Claim Amount"])[0] == "insurance"
    assert naming.detect_domain(["x"]) is None
    assert naming.classify_kpi("Claim Severity") == ("Claim severity", "lower")
    cands = [{"column": "Score", "type": "number", "cv": 1}, {"column": "Total Revenue", "type": "currency", "cv": 0.1}]
    assert naming.pick_metric(cands) == "Total Revenue"
    assert naming.pick_metric([{"column": "q", "type": "number", "cv": 3}, {"column": "w", "type": "currency", "cv": 0.1}]) == "w"
    assert naming.pick_metric([]) is None


@pytest.mark.parametrize("width", [2, 5, 6, 13])
def test_pearson_of_many_columns_with_gaps(spark, width):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(60, width)) + rng.normal(size=(60, 1))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 0] = 7.0
    names = [f"column {i}" for i in range(width)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in names))
    got = {(r.a, r.b): (r.n, r.r) for r in relations.pearson_pairs(df, names).collect()}
    assert set(got) == {(a, b) for i, a in enumerate(names) for b in names[i + 1 :]}
    for (a, b), (n, r) in got.items():
        u, v = x[:, names.index(a)], x[:, names.index(b)]
        both = ~np.isnan(u) & ~np.isnan(v)
        assert n == both.sum()
        assert r is None if a == names[0] else abs(r - np.corrcoef(u[both], v[both])[0, 1]) < 1e-9
    if width == 2:
        assert relations.correlations(df.union(df), names).count() == 0  # a constant column, also among ranks
    plan = relations.pearson_pairs(df, names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1


def test_paretos_of_all_columns_are_those_of_each(spark):
    rows = [("a", "x", 5.0), ("b", "x", 3.0), (None, "y", 3.0), ("a", " ", None), ("c", "z", 0.5)]
    df = frame(spark, rows, "k string, g string, v double")
    many = explore.paretos(df, ["k", "g"], "v")
    for c in ("k", "g"):
        assert sorted(many.filter(f"column = '{c}'").drop("column").collect()) == sorted(explore.pareto(df, c, "v").collect())
        assert many.filter(f"column = '{c}'").agg({"cum_share": "max"}).first()[0] == pytest.approx(100.0)
    heads = {r.column: r.count_to_80 for r in explore.pareto_summary(many, ["column"]).collect()}
    assert heads == {c: one(explore.pareto_summary(explore.pareto(df, c, "v")))["count_to_80"] for c in ("k", "g")}


def test_what_shows_as_zero_has_no_sign(spark, tmp_path):
    from datascry.plans import queries
    from datascry.plans.findings import show

    cells = [-0.0, 0.0, -0.004, -12.5, 10.0, 9999.5]
    got = spark.createDataFrame(list(enumerate(cells)), "i int, v double").orderBy("i").select(values.fmt_num(F.col("v"), currency=True)).collect()
    assert [r[0] for r in got] == [show(v, True) for v in cells] == ["$0", "$0", "$0", "$-12.5", "$10", "$9,999.5"]
    # prices below a cent, as the query's SQL takes them
    spark.createDataFrame([(500, 1001.125), (501, 9999.996)], "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, -0.0), (2, -0.004), (3, 0.005)], "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    assert {r[0]: r[1] for r in queries.format_number(spark, str(tmp_path)).collect()} == {500: "$1,001.13", 501: "$10.0K", -1: "$0", -2: "$0", -3: "$0.01"}


def test_profile_of_many_columns_is_one_set_of_aggregates(spark):
    df = spark.range(50).select(*[(F.col("id") * (i + 1)).cast("double").alias(f"c{i}") for i in range(9)])
    plans = [profile.numeric_profile(df, df.columns[:k])._jdf.queryExecution().optimizedPlan().toString() for k in (1, 9)]
    assert plans[0].count("skewness(") == plans[1].count("skewness(") > 0
    got = {r["column"]: r for r in profile.numeric_profile(df, df.columns).collect()}
    assert [got[f"c{i}"]["position"] for i in range(9)] == list(range(9)) and all(got[f"c{i}"]["mean"] == 24.5 * (i + 1) and got[f"c{i}"]["distinct"] == 50 for i in range(9))
    none = profile.numeric_profile(df.limit(0), ["c0", "c1"]).collect()
    assert [(r["total"], r["n"], r["mean"], r["sd"], r["distinct"], r["median"]) for r in none] == [(0, 0, None, 0.0, 0, None)] * 2


def test_cells_give_what_scans_of_rows_give(spark):
    """Moments, segments, overlap and Pareto of combinations of levels: blanks, gaps, far values and a level of one row."""
    rng = random.Random(8)
    rows = []
    for i in range(900):
        a, b = rng.choice(["x", " x ", "y", "", None, "(blank)"]), rng.choice("pqr")
        rows.append((a, "once" if i == 7 else b, None if i % 11 == 0 else 1e6 + rng.gauss(0, 1) + (b == "p"), float("nan") if a == "y" else rng.random()))
    df = frame(spark, rows, "a string, b string, v double, w double")
    names, metrics = ["a", "b"], ["v", "w"]
    cells = relations.level_cells(df, names, metrics).persist()
    moments = relations.moments_of(cells, names, metrics)
    got = {(r.driver, r.metric, r.level): r for r in moments.collect()}
    want = {(r.driver, r.metric, r.level): r for r in relations.group_moments(df, names, metrics).collect()}
    assert got.keys() == want.keys() and sum(r.rows for r in got.values() if r.driver == "a" and r.metric == "v") == 900
    for k, r in want.items():
        assert (got[k].n, got[k].lo, got[k].hi) == (r.n, r.lo, r.hi)
        # a mean near 1e6 is known to 1e-10, beside a spread of one
        for x, e in (("mean", 1e-12), ("sum", 1e-12), ("var", 1e-8)):
            one, other = getattr(got[k], x), getattr(r, x)
            assert one is other is None or one == pytest.approx(other, rel=e), (k, x)

    def by_key(found, *keys):
        return {tuple(r[k] for k in keys): [r[c] for c in found.columns if c not in (*keys, "median")] for r in found.collect()}

    def same(one, other):
        assert one.keys() == other.keys() and one
        assert all(a == pytest.approx(b, rel=1e-6, abs=1e-6) if isinstance(b, float) else a == b for k in one for a, b in zip(one[k], other[k], strict=True))

    scans = [relations.segment_scan(df, names, "v", middle=False, moments=m) for m in (moments, None)]
    same(*[by_key(s, "column", "value") for s in scans])
    counted = cells.select(F.col("rows").alias("_rows"), F.col("c0").alias("a"), F.col("c1").alias("b"))
    same(*[by_key(relations.cramers_v(*x), "a", "b") for x in ((counted, [("a", "b")], 20, 30, "_rows"), (df, [("a", "b")]))])
    sums = moments.filter("metric = 'v' and n > 0").select(F.col("driver").alias("column"), F.col("level").alias("key"), F.col("sum").alias("value"))
    same(*[by_key(x, "column", "key") for x in (explore.pareto_items(sums), explore.paretos(df, names, "v"))])
    cells.unpersist()
