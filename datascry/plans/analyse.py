"""The whole analysis of one table: a fixed plan of operators, then findings.

Every result is a DataFrame over few rows (one per column, pair, level or day).
Only such rows reach the driver: for eligibility, the headline and the findings.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datascry.functions.values import overlap_label
from datascry.operators import explore as X
from datascry.operators import profile as P
from datascry.operators import relations as R
from datascry.operators import series as S
from datascry.operators.ranks import cuts_of
from datascry.plans.naming import detect_domain, pick_metric
from datascry.sources.infer import GROUPABLE, NUMERIC, infer_types
from datascry.sources.tables import with_row_numbers

# Eligibility and keep thresholds.
MOST_LEVELS, MOST_CATEGORIES, MOST_METRICS, MOST_PARETO, MOST_COMPOSITIONS = 60, 25, 14, 6, 4
#: Combinations of levels that one grouping counts at most.
MOST_CELLS = 50_000
LEAST_R, LEAST_ETA2, LEAST_V, LEVEL = 0.15, 0.005, 0.12, 0.05


@dataclass
class Report:
    """Frames by name, and what the driver holds of them."""

    types: dict[str, str]
    source: DataFrame | None = None
    frames: dict[str, DataFrame] = field(default_factory=dict)
    rows: int = 0
    profiles: list[dict] = field(default_factory=list)
    metric: str | None = None
    date: str | None = None
    domain: tuple[str, str, list[str]] | None = None
    quality: dict = field(default_factory=dict)
    lists: dict[str, list[dict]] = field(default_factory=dict)
    findings: list[dict] = field(default_factory=list)
    strip: list[dict] = field(default_factory=list)
    summary: str = ""
    actions: list[str] = field(default_factory=list)
    # what :func:`begin` settles for the parts, and the parts made so far
    row: str | None = None
    cached: bool = False
    numeric: list[str] = field(default_factory=list)
    base: list[str] = field(default_factory=list)
    dates: list[str] = field(default_factory=list)
    edges: dict[str, list[float]] = field(default_factory=dict)
    done: set[str] = field(default_factory=set)

    def type_of(self, name: str | None) -> str:
        return self.types.get(name or "", "text")

    @cached_property
    def by(self) -> dict[str, dict]:
        return {p["column"]: p for p in self.profiles}

    @cached_property
    def binned(self) -> DataFrame:
        """The table with bands of its numeric columns."""
        return R.with_quintiles(self.source, self.numeric, max(0, MOST_CATEGORIES - len(self.base)), self.edges)

    @cached_property
    def categories(self) -> list[str]:
        return self.base + [c for c in self.binned.columns if c not in self.source.columns]

    @property
    def metrics(self) -> list[str]:
        return list(dict.fromkeys([m for m in (self.metric, *self.numeric) if m]))[:MOST_METRICS]

    @cached_property
    def cuts(self) -> dict[str, list[float]]:
        """One sketch of each column for all ranks, medians and deciles."""
        return cuts_of(self.source, {c: P.number(self.source, c) for c in self.numeric})

    @cached_property
    def cells(self) -> list[tuple[list[str], DataFrame]]:
        """Combinations of levels with moments of all metrics, of as many categories at a time as keep them few;
        a scan for each."""
        packs: list[list[str]] = []
        size = 0
        for c in self.categories:
            levels = (self.by[c]["distinct"] if c in self.by else len(P.FIFTHS) - 1) + 1  # and blank
            if packs and size * levels <= MOST_CELLS:
                packs[-1].append(c)
                size *= levels
            else:
                packs.append([c])
                size = levels
        made = [(pack, R.level_cells(self.binned, pack, self.metrics)) for pack in packs]
        return [(pack, one.persist() if self.cached else one) for pack, one in made]  # MOST_CELLS rows at most

    @cached_property
    def moments(self) -> DataFrame | None:
        if not self.categories or not self.metrics:
            return None
        found = [R.moments_of(one, pack, self.metrics) for pack, one in self.cells]
        out = reduce(DataFrame.unionByName, found)
        return out.persist() if self.cached else out  # a row for each level and metric

    @cached_property
    def crossed(self) -> tuple[DataFrame, str | None]:
        """Rows with all base categories, and the column that says how many of the table's each stands for."""
        pack, one = self.cells[0] if self.cells else ([], None)
        if one is None or not set(self.base) <= set(pack):
            return self.source, None
        return one.select(F.col("rows").alias("_rows"), *[F.col(f"c{pack.index(c)}").alias(c) for c in self.base]), "_rows"

    @property
    def scanned(self) -> list[str]:
        return [c for c in self.categories if c != f"{self.metric} (quintile)"] if self.metric else []

    @property
    def composed(self) -> list[str]:
        return [c for c in self.base if 2 <= self.by[c]["distinct"] <= 10][:MOST_COMPOSITIONS]

    @cached_property
    def items(self) -> DataFrame | None:
        """Pareto tables of the categories."""
        if not self.metric or not self.base:
            return None
        mine = self.moments.filter(F.col("driver").isin([*self.base[:MOST_PARETO], *self.composed]) & (F.col("metric") == self.metric) & (F.col("n") > 0))
        return X.pareto_items(mine.select(F.col("driver").alias("column"), F.col("level").alias("key"), F.col("sum").alias("value")))

    @cached_property
    def odd(self) -> DataFrame | None:
        """Outlying numbers and rare categories."""
        df, row = self.source, self.row
        odd = R.outliers(df if row else with_row_numbers(df, "_row"), self.numeric, row or "_row", profiles=self.by) if self.numeric else None
        worded = [c for c, t in self.types.items() if t == "category" and self.by[c]["complete"] > 50]
        if odd is not None and worded:
            odd = odd.withColumn("row", F.col("row").cast("string")).withColumn("category", F.lit(None).cast("string"))
        for c in worded:
            if odd is not None and not self.by[c]["singletons"]:
                continue  # counted already: no value occurs once
            rare = R.rare_categories(df, c).select(
                "column", F.lit(None).cast("string").alias("row"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("z"),
                F.lit(None).cast("double").alias("expected"), F.lit("rare category").alias("method"), F.lit("low").alias("severity"), F.lit("rare").alias("direction"), F.col("value").alias("category"),
            )
            odd = rare if odd is None else odd.unionByName(rare)
        return odd

    @cached_property
    def points(self) -> int:
        """How many days the series has; from six on it is among the frames."""
        if not self.dates or not self.metric:
            return 0
        daily = S.daily_series(self.source, self.dates[0], self.metric)
        s = S.trim_partial(daily.persist() if self.cached else daily)
        s = s.persist() if self.cached else s  # a row for each day, as in ``daily``
        n = s.count()
        daily.unpersist()
        if n > 5:
            self.frames |= {"series": s, "forecast": S.forecast(s), "weekdays": S.weekday_seasonality(s), "months": S.month_seasonality(s)}
        return n


def _rows(df: DataFrame | None) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()] if df is not None else []


def parsed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """``df`` with text cells of numeric columns as numbers and of dates as timestamps: what
    follows need not parse them again."""
    text = {c for c, t in df.dtypes if t == "string"}
    made = {c: P.number(df, c) for c in text if types.get(c) in NUMERIC} | {c: P.instant(df, c) for c in text if types.get(c) == "date"}
    return df.withColumns(made) if made else df


def profile_all(df: DataFrame, types: Mapping[str, str], ready: DataFrame | None = None) -> list[dict]:
    """One record per column, in file order: completeness, and by type numbers,
    dates or value counts.  ``ready`` is ``df`` as :func:`parsed` gives it.  Distinct numbers are
    left to :func:`count_numbers`."""
    ready = ready or parsed(df, types)
    names = [c for c in df.columns if c in types]
    out = {r["column"]: r | {"type": types[r["column"]]} for r in _rows(P.missingness(df, names))}
    numeric = [c for c in names if types[c] in NUMERIC]
    if numeric:
        for r in _rows(P.numeric_profile(ready, numeric, report=True)):
            # a cell that is no number is not missing: that is known of the cells as read
            out[r["column"]] |= {k: v for k, v in r.items() if k not in ("total", "missing", "missing_pct")}
    for c in names:
        if types[c] == "date":
            out[c] |= _rows(P.date_profile(df, c))[0]
    worded = [c for c in names if types[c] not in (*NUMERIC, "date")]
    keyed = worded or names[:1]
    counts = P.all_key_counts(df, keyed).persist()
    for r in _rows(P.concentrations(df, worded, counts)) if worded else []:
        out[r["column"]] |= r
    grouped = [c for c in worded if types[c] in GROUPABLE]
    for c in grouped:
        out[c]["top"] = []
    mine = counts.filter(F.col("i").isin([keyed.index(c) for c in grouped]))
    for r in sorted(_rows(P.top_values(df, keyed, counts=mine)) if grouped else [], key=lambda r: r["place"]):
        out[r["column"]]["top"].append({k: r[k] for k in ("key", "n", "pct")})
    for r in _rows(P.case_variants(df, keyed, counts)):
        out[r["column"]]["variants"] = r["variants"]
    counts.unpersist()
    for c, p in out.items():
        p["constant"] = (p["min"] == p["max"]) if c in numeric else (p.get("distinct") or 0) <= 1
    return [out[c] for c in names]


def count_numbers(df: DataFrame, profiles: Sequence[dict]) -> None:
    """Gives profiles of numbers that lack it their count of distinct values; they are counted by a shuffle of all."""
    open_ = [p for p in profiles if p["type"] in NUMERIC and "distinct" not in p]
    got = {r["column"]: r["distinct"] for r in _rows(P.distinct_numbers(df, [p["column"] for p in open_]) if open_ else None)}
    for p in open_:
        p["distinct"] = got.get(p["column"], 0)


#: Rows among which a repeated value shows that a column is no key.
FIRST_ROWS = 20_000


def _keyed(df: DataFrame, profiles: Sequence[dict]) -> bool:
    """Whether a column has as many values as there are rows.  Columns of numbers are counted one by one,
    but for those that have gaps or repeat a value among the first rows."""
    if any(p["total"] == p.get("distinct") for p in profiles):
        return True
    full = [p for p in profiles if p["type"] in NUMERIC and p["n"] == p["total"]]
    first = [dict(p) for p in full]
    count_numbers(df.limit(FIRST_ROWS), first)
    for p, f in zip(full, first, strict=True):
        if f["distinct"] == min(FIRST_ROWS, p["total"]):
            count_numbers(df, [p])
            if p["distinct"] == p["total"]:
                return True
    return False


def _sure(r: dict) -> bool:
    return r["p_adj"] is not None and r["p_adj"] < LEVEL


# ------------------------------------------------------------ parts


def _correlated(rep: Report, found: DataFrame | None) -> None:
    places = {c: i for i, c in enumerate(rep.numeric)}
    rep.lists["correlations_all"] = sorted(_rows(found), key=lambda r: (-abs(r["r"]), places[r["a"]], places[r["b"]]))
    rep.lists["correlations"] = [r for r in rep.lists["correlations_all"] if abs(r["r"]) >= LEAST_R and _sure(r)]


def _links(rep: Report) -> None:
    _correlated(rep, R.links(rep.source, rep.numeric) if len(rep.numeric) > 1 else None)


def _curves(rep: Report) -> None:
    """Which of the links are curved: ranks of pairs where r leaves room for it."""
    room = [r for r in rep.lists["correlations"] if 1.0 - abs(r["r"]) > R.CURVED]
    names = [c for c in rep.numeric if any(c in (r["a"], r["b"]) for r in room)]
    ranked = {(r["a"], r["b"]): r["rho"] for r in _rows(R.spearman_pairs(rep.source, names, rep.cuts) if names else None)}
    for r in rep.lists["correlations"]:
        rho = ranked.get((r["a"], r["b"]))
        r["nonlinear"] = rho is not None and abs(rho) - abs(r["r"]) > R.CURVED


def _correlations(rep: Report) -> None:
    """Links and curves with the ranks of all pairs."""
    if len(rep.numeric) > 1:
        rep.frames["correlations"] = R.correlations(rep.source, rep.numeric, rep.cuts)
        rep.frames["corr_matrix"] = R.corr_matrix(rep.source, rep.numeric)
    _correlated(rep, rep.frames.get("correlations"))
    rep.done |= {"links", "curves"}


def _drivers(rep: Report) -> None:
    if rep.moments is not None:
        rep.frames["drivers"] = R.driver_effects(rep.moments)
    rep.lists["drivers_all"] = sorted(_rows(rep.frames.get("drivers")), key=lambda r: -r["eta2"])
    rep.lists["drivers"] = [r for r in rep.lists["drivers_all"] if r["eta2"] > LEAST_ETA2 and _sure(r)]


def _associations(rep: Report) -> None:
    if len(rep.base) > 1:
        rows, weight = rep.crossed
        rep.frames["associations"] = R.cramers_v(rows, list(combinations(rep.base, 2)), weight=weight).withColumn("reading", overlap_label(F.col("v")))
    rep.lists["associations_all"] = sorted(_rows(rep.frames.get("associations")), key=lambda r: -r["v"])
    rep.lists["associations"] = [r for r in rep.lists["associations_all"] if r["v"] >= LEAST_V and r["reliable"] and _sure(r)]


def _outlier_counts(rep: Report) -> None:
    if rep.odd is not None:
        rep.frames["outliers"] = rep.odd
        rep.lists["outlier_counts"] = _rows(rep.odd.groupBy("severity").count())


def _outliers(rep: Report) -> None:
    if rep.odd is not None:
        rep.lists["outliers"] = _rows(rep.odd.orderBy(F.desc_nulls_last(F.abs("z")), "column", "row").limit(60))


def _scan(rep: Report, found: DataFrame | None) -> None:
    rep.lists["segments"] = sorted(_rows(found), key=lambda r: (-abs(r["t"]), r["column"], r["value"]))


def _segments(rep: Report) -> None:
    """The scan without medians."""
    _scan(rep, R.segment_scan(rep.binned, rep.scanned, rep.metric, middle=False, moments=rep.moments) if rep.scanned else None)


def _segment_medians(rep: Report) -> None:
    if rep.scanned:
        rep.frames["segments"] = R.segment_scan(rep.binned, rep.scanned, rep.metric, rep.cuts[rep.metric], few=True, moments=rep.moments)
        rep.frames["hot_and_cold"] = R.hot_and_cold(rep.frames["segments"])
    _scan(rep, rep.frames.get("segments"))
    rep.done.add("segments")


def _paretos(rep: Report) -> None:
    rep.lists["paretos"] = []
    if rep.items is not None:
        heads = X.pareto_summary(rep.items, ["column"]).withColumn("metric", F.lit(rep.metric)).filter("items >= 3")
        firsts = [r for r in _rows(heads) if r["column"] in rep.base[:MOST_PARETO]]
        rep.lists["paretos"] = sorted(firsts, key=lambda r: (r["pct80"], rep.base.index(r["column"])))


def _trend(rep: Report) -> None:
    if rep.dates and rep.metric:
        rep.lists["series_points"] = [{"points": rep.points}]
    if rep.points > 5:
        rep.lists["fit"] = _rows(S.fit_series(rep.frames["series"]))


def _forecast(rep: Report) -> None:
    if rep.points > 5:
        rep.lists["forecast"] = _rows(rep.frames["forecast"])


def _rhythm(rep: Report) -> None:
    if rep.points > 5:
        s = rep.frames["series"]
        for name, one in (("momentum", S.momentum(s)), ("extremes", S.extremes(s)), ("volatility", S.volatility(s)), ("weekdays", rep.frames["weekdays"])):
            rep.lists[name] = _rows(one)


def _top_decile(rep: Report) -> None:
    if rep.metric:
        ten = X.decile_share(rep.source, rep.metric, rep.cuts[rep.metric]).filter("decile = 10").select("share")
        rep.lists["top_decile"] = _rows(ten)


#: Parts of a report by name; each fills its lists.
PARTS = {
    "correlations": _correlations, "links": _links, "curves": _curves, "drivers": _drivers, "associations": _associations, "outlier_counts": _outlier_counts, "outliers": _outliers,
    "segment_medians": _segment_medians, "segments": _segments, "paretos": _paretos, "trend": _trend, "forecast": _forecast, "rhythm": _rhythm, "top_decile": _top_decile,
}
# What the headline strip, the next steps, the summary (which counts findings) and the findings show.
STRIP = ("drivers", "links", "outlier_counts", "trend", "forecast")
ACTIONS = ("drivers", "links", "curves", "associations", "outlier_counts")
SUMMARY = ("drivers", "links", "associations", "outlier_counts", "outliers", "segments", "paretos", "trend", "rhythm")
FINDINGS = (*SUMMARY, "curves", "top_decile")


def work_out(rep: Report, parts: Iterable[str]) -> Report:
    """``rep`` with those parts; what it has already stays."""
    for part in parts:
        if part not in rep.done:
            PARTS[part](rep)
            rep.done.add(part)
    return rep


def begin(df: DataFrame, types: Mapping[str, str] | None = None, row: str | None = None, cache: bool = True) -> Report:
    """A report with types, profiles and quality, of which parts can be worked out; arguments as of :func:`analyse`."""
    names = [c for c in df.columns if c != "_row"]
    raw = df.persist() if cache else df
    rep = Report(infer_types(raw, names, types), row=row, cached=cache)
    df = parsed(raw, rep.types)
    again = cache and df is not raw
    if again:
        df = df.persist()
    rep.source = df
    rep.profiles = profile_all(raw, rep.types, df)
    fifths = {p["column"]: p.pop("fifths") for p in rep.profiles if "fifths" in p}
    # where a column has as many values as rows, no row repeats another
    duplicates = P.duplicate_rows(raw, names).first()[0] if names and not _keyed(df, rep.profiles) else 0
    if again:
        df.count()  # held before what it is made of goes
        raw.unpersist()
    rep.rows = rep.profiles[0]["total"] if rep.profiles else 0
    by = rep.by
    rep.numeric = [c for c in names if rep.types[c] in NUMERIC and not by[c]["constant"] and by[c]["n"] > 4]
    rep.base = [c for c in names if rep.types[c] in GROUPABLE and not by[c]["constant"] and by[c]["distinct"] <= MOST_LEVELS]
    rep.edges = {c: R.usable_edges(by[c]["n"], fifths[c]) for c in rep.numeric}
    rep.dates = [c for c in names if rep.types[c] == "date" and by[c]["n"] > 3]
    rep.metric = pick_metric([by[c] for c in rep.numeric])
    rep.date = rep.dates[0] if rep.dates and rep.metric else None
    rep.domain = detect_domain(names)
    facts = df.sparkSession.createDataFrame(
        [(p["column"], p["type"], float(p["missing_pct"]), p["constant"] and p["complete"] > 0, float(p.get("skew") or 0), int(p.get("variants") or 0)) for p in rep.profiles],
        "column string, type string, missing_pct double, constant boolean, skew double, variants long",
    )
    rep.frames["quality_issues"] = P.quality_issues(df, facts, duplicates)
    rep.lists["issues"] = _rows(rep.frames["quality_issues"])
    rep.quality = _rows(P.quality_score(rep.frames["quality_issues"]))[0] | {"duplicates": duplicates}
    return rep


def analyse(df: DataFrame, types: Mapping[str, str] | None = None, row: str | None = None, cache: bool = True) -> Report:
    """The report of a table; ``types`` overrides inferred types, ``row`` names a
    column that identifies rows in the list of outliers (by default the 1-based place
    among the rows as read).

    Dozens of scans follow, so the table with its cells parsed is kept in Spark's cache (memory,
    then disk) until ``report.source.unpersist()``, and its daily series with it until
    ``report.frames["series"].unpersist()``; ``cache=False`` reads it each time.
    """
    rep = work_out(begin(df, types, row, cache), PARTS)
    count_numbers(rep.source, rep.profiles)
    df, f, spark = rep.source, rep.frames, rep.source.sparkSession
    if rep.moments is not None:
        f["driver_levels"] = R.driver_levels(rep.moments, R.group_medians(rep.binned, rep.categories, rep.metrics, rep.cuts, few=True))
    if rep.items is not None:
        f |= {f"pareto:{c}": rep.items.filter(F.col("column") == c).drop("column") for c in rep.base[:MOST_PARETO]}
        f |= {f"composition:{c}": X.composition(df, c, rep.metric) for c in rep.composed}
        bars = rep.items.filter(F.col("column").isin(rep.composed) & (F.col("place") <= X.COMPOSED)).orderBy("column", "place")
        rep.lists |= {f"composition:{c}": [] for c in rep.composed}
        for r in _rows(bars):
            rep.lists[f"composition:{r['column']}"].append({k: r[k] for k in ("key", "value", "place", "share")})
    if rep.metric and not rep.dates:
        f["ordered_trends"] = X.ordered_trends(rep.binned, rep.categories, rep.metric, cuts=rep.cuts[rep.metric])
        for c in [c for c in rep.base if 3 <= rep.by[c]["distinct"] <= 14][:1]:
            f["volume"] = X.volume_profile(df, c, rep.metric)
    if rep.date:
        f["period"] = S.month_breakdown(df, rep.date, rep.metric, rep.cuts[rep.metric])
    for side, over in (("above", True), ("below", False)):
        mine = [r for r in rep.lists["segments"] if (r["lift"] > 0) == over and r["lift"] != 0][:12]
        rep.lists.setdefault("hot_and_cold", []).extend({"side": side, "place": i} | r for i, r in enumerate(mine, 1))
    for name in ("ordered_trends", "volume", "period", "corr_matrix"):
        if name in f:
            rep.lists[name] = _rows(f[name])
    if len(rep.lists.get("period") or []) > 1:
        rep.lists["period_extremes"] = _rows(S.month_extremes(spark.createDataFrame(rep.lists["period"], f["period"].schema)))
    rep.lists["noise"] = _rows(spark.range(1).select(*P.noise_floor(F.lit(rep.rows))))
    if rep.metric:
        rep.lists["histogram"] = _rows(P.histogram(df, rep.metric))

    from datascry.plans.display import kpi_strip
    from datascry.plans.findings import build_actions, build_findings, build_summary

    rep.findings = build_findings(rep)
    rep.summary = build_summary(rep)
    rep.actions = build_actions(rep)
    rep.strip = kpi_strip(rep)
    return rep
