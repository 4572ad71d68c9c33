"""Ranked plain-language findings, the summary and next steps, from a report's lists."""

from __future__ import annotations

import html
import re
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from datascry.plans.analyse import Report


def show(v: float | None, currency: bool = False) -> str:
    """Short display of a number, as ``functions.values.fmt_num`` gives it."""
    if v is None or v != v or v in (float("inf"), float("-inf")):
        return "—"
    sign, a = "$" if currency else "", abs(v)
    for least, by, digits, suffix in ((1e9, 1e9, 2, "B"), (1e6, 1e6, 2, "M"), (1e4, 1e3, 1, "K")):
        if a >= least:
            return f"{sign}{v / by:.{digits}f}{suffix}"
    if not currency and 0 < a < 0.01:
        return f"{v:.2e}".replace("e-0", "e-").replace("e+0", "e+")
    said = f"{v:,.2f}".rstrip("0").rstrip(".")
    return sign + ("0" if said == "-0" else said)


def show_p(p: float | None, letter: str = "p") -> str:
    return "—" if p is None or p != p else f"{letter} < 0.001" if p < 0.001 else f"{letter} = {p:.3f}"


def escape(s: object) -> str:
    return html.escape(str(s), quote=True)


def shorten(s: object, n: int) -> str:
    return str(s) if len(str(s)) <= n else str(s)[: n - 1] + "…"


def plain_name(s: str) -> str:
    """A column name without the marks of its bands, so that restatements meet."""
    # fixed values: suffixes of banded columns
    s = re.sub(r"\s*\((quintile|quartile|decile|bucket|bin|band)\)\s*", "", s.lower())
    return re.sub(r"\s+(bracket|band|range|tier|group|category|bucket|bin|level)s?$", "", s).strip()


def _tone(v: float, strong: float, medium: float) -> str:
    return "strong" if v >= strong else "medium" if v >= medium else "weak"


def build_findings(rep: Report) -> list[dict]:
    """Findings by falling score; of restatements only the first stays."""
    out: list[dict] = []
    cur = rep.type_of(rep.metric) == "currency"
    lists = rep.lists

    def add(kind: str, score: float, tone: str, title: str, body: str, key: tuple | None = None) -> None:
        out.append({"kind": kind, "score": round(float(score), 6), "tone": tone, "title": title, "body": body, "key": key})

    mine = [d for d in lists["drivers"] if d["metric"] == rep.metric][:6]
    others = [d for d in lists["drivers"] if d["metric"] != rep.metric][:5]
    for i, d in enumerate(mine + others):
        effect, c = d["omega2"], rep.type_of(d["metric"]) == "currency"
        tone = _tone(effect, 0.14, 0.06)
        add(
            "driver", 100 * effect + 25 * (d["metric"] == rep.metric) + 12 * (i == 0) + 8, tone,
            f"{d['driver']} goes with {d['metric']} ({tone})",
            f"{d['levels']} groups of {d['driver']} explain {100 * d['eta2']:.1f}% of the spread of {d['metric']} (omega² {effect:.3f}, {show_p(d['p_adj'], 'q')}): "
            f"from {show(d['bottom']['mean'], c)} for {d['bottom']['level']} to {show(d['top']['mean'], c)} for {d['top']['level']}. An association, not a cause.",
            ("driver", plain_name(d["driver"]), plain_name(d["metric"])),
        )
    for i, r in enumerate(lists["correlations"][:8]):
        a = abs(r["r"])
        same = "nearly the same column as" if r["duplicate"] else "rises with" if r["r"] > 0 else "falls with"
        curve = " The ranks agree more than the values: the relation is curved." if r.get("nonlinear") else ""
        add("correlation", 70 * a + 10 * (i == 0) + 6, _tone(a, 0.6, 0.4), f"{r['a']} {same} {r['b']}",
            f"r = {r['r']:.3f} ({r['strength']}), {show_p(r['p_adj'], 'q')}, n = {r['n']}; {100 * a * a:.0f}% of the variation is shared.{curve}")
    for r in lists["associations"][:5]:
        add("assoc", 45 * r["v"], _tone(r["v"], 0.4, 0.2), f"{r['a']} overlaps with {r['b']}",
            f"Cramér's V = {r['v']:.3f}, {show_p(r['p_adj'], 'q')}, n = {r['n']}." + (" One may stand for the other." if r["v"] > 0.7 else ""))
    for s in lists["segments"][:6]:
        if s["p_adj"] is not None and s["p_adj"] < 0.05:
            t = abs(s["t"])
            add("segment", 12 * min(6, t), "strong" if t >= 4 else "medium", f"{s['column']} = {shorten(s['value'], 28)} differs on {rep.metric}",
                f"{s['n']} rows ({s['share']:.1f}%) average {show(s['mean'], cur)}, {s['lift']:+.1f}% against all (Welch t = {s['t']:.1f}, {show_p(s['p_adj'], 'q')}).",
                ("segment", plain_name(s["column"]), round(s["lift"]), s["n"]))
    numeric = [p for p in rep.profiles if p["type"] in ("number", "currency", "percent")]
    for p in [p for p in numeric if p["n"] > 20][:30]:
        c = p["type"] == "currency"
        if abs(p["skew"]) > 1.5:
            add("distribution", 18 + min(10, 2 * abs(p["skew"])), "medium", f"{p['column']} leans {'right' if p['skew'] > 0 else 'left'}",
                f"Mean {show(p['mean'], c)}, median {show(p['median'], c)} (skew {p['skew']:.2f}): the median says more.")
        if p["cv"] > 1:
            add("distribution", 14, "medium", f"{p['column']} scatters widely", f"The deviation {show(p['sd'], c)} is above the mean {show(p['mean'], c)} (ratio {p['cv']:.2f}).")
    for r in lists["paretos"][:4]:
        add("concentration", 20 + 15 * (r["pct80"] < 30), "strong" if r["pct80"] < 25 else "medium", f"{r['metric']} by {r['column']}: {r['count_to_80']} of {r['items']} make 80%",
            f"The largest, {r['top_key']}, has {r['top_share']:.1f}%.")
    fit = (lists.get("fit") or [None])[0]
    points = (lists.get("series_points") or [{"points": 0}])[0]["points"]
    if fit and points > 6:
        flat = fit["r2"] < 0.15
        way = "no clear trend" if flat else "a rising trend" if fit["slope"] > 0 else "a falling trend" if fit["slope"] < 0 else "a level trend"
        add("trend", 30 if flat else 60 + 25 * fit["r2"], _tone(fit["r2"], 0.5, 0.2), f"{rep.metric} shows {way} over {rep.date}",
            f"A line explains {100 * fit['r2']:.1f}% of the daily sums; slope {show(fit['slope'], cur)} a day, {fit['first']} to {fit['last']}.")
    week = sorted([w for w in lists.get("weekdays") or [] if w["n"] >= 3], key=lambda w: -w["index"])
    if len(week) >= 5 and week[0]["index"] - week[-1]["index"] > 25:
        days = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
        add("seasonality", 30, "medium", "Weekdays differ", f"{days[week[0]['part']]} runs at {week[0]['index']:.0f}% of the mean, {days[week[-1]['part']]} at {week[-1]['index']:.0f}%.")
    for m in lists.get("momentum") or []:
        if abs(m["change_pct"]) > 3:
            add("momentum", 48 + min(18, abs(m["change_pct"]) / 4), "strong" if abs(m["change_pct"]) > 25 else "medium",
                f"The later half runs {'ahead of' if m['change_pct'] >= 0 else 'behind'} the earlier one",
                f"{show(m['recent'], cur)} a day since {m['split']} against {show(m['prior'], cur)} before ({m['change_pct']:+.1f}%).")
    for e in lists.get("extremes") or []:
        add("extremes", 26, "medium", f"Best and worst day of {rep.metric}", f"{show(e['best'], cur)} on {e['best_day']}, {show(e['worst'], cur)} on {e['worst_day']}; median {show(e['median'], cur)}.")
    for v in lists.get("volatility") or []:
        add("volatility", 24 + min(14, 20 * v["cv"]), _tone(v["cv"], 0.5, 0.25), f"{rep.metric} moves {v['median_step']:.1f}% from day to day", f"Median step; coefficient of variation {v['cv']:.2f}.")
    for p in [p for p in rep.profiles if p["type"] == "category" and (p.get("distinct") or 0) > 1][:12]:
        ruling = p["top_share"] > 60
        score = 16 + 12 * ruling + 4 * (p["singletons"] > 0) + 10 * (not any(f["kind"] == "driver" for f in out))
        top = p["top"][0] if p.get("top") else {"key": "", "pct": 0.0}
        title = f"{p['column']} is mostly {shorten(top['key'], 24)}" if ruling else f"{p['column']} is spread evenly" if p["balance"] > 0.9 else f"{p['column']} has {p['distinct']} groups"
        add("composition", score, "medium" if ruling else "weak", title, f"Largest: {top['key']} with {top['pct']:.1f}%; evenness {100 * p['balance']:.0f}% of its maximum.")
    counts = {r["severity"]: r["count"] for r in lists.get("outlier_counts") or []}
    if counts:
        total, top = sum(counts.values()), lists["outliers"][0]
        far = f"the farthest is {show(top['value'])} in {top['column']} ({top['z']:+.1f} deviations, usually {show(top['expected'])})" if top["z"] is not None else f"all occur once, such as {top['category']} in {top['column']}"
        add("anomaly", 40 + min(20, total), "strong" if counts.get("high") else "medium", f"{total} outlying values",
            f"{counts.get('high', 0)} at four deviations and more; {far}.")
    head = next((p for p in rep.profiles if p["column"] == rep.metric), None)
    if head:
        tenth = (lists.get("top_decile") or [{"share": 0.0}])[0]["share"]
        add("metric", 55, "strong", f"{rep.metric} at a glance",
            f"{head['n']:,} values, sum {show(head['sum'], cur)}, mean {show(head['mean'], cur)}, median {show(head['median'], cur)}, middle half {show(head['q1'], cur)} to {show(head['q3'], cur)}; the top tenth holds {tenth:.1f}%.")
    rest = [p for p in numeric if p["column"] != rep.metric and p["n"] > 10]
    wide = max(rest, key=lambda p: p["cv"] or 0.0, default=None)
    if wide and wide["cv"] > 0.35:
        c = wide["type"] == "currency"
        add("metric", 20, "weak", f"{wide['column']} has a wide range", f"{show(wide['min'], c)} to {show(wide['max'], c)}, median {show(wide['median'], c)}.")
    if not lists["drivers"] and not lists["correlations"] and not lists["associations"] and rep.rows > 50:
        tested = [len(lists[k]) for k in ("drivers_all", "correlations_all", "associations_all")]
        add("nosignal", 95, "medium", "No relation passed the adjusted tests", f"Tested: {tested[0]} drivers, {tested[1]} numeric pairs, {tested[2]} category pairs. That proves no independence.")
    if rep.quality["issues"]:
        severe = rep.quality["severe"]
        add("quality", 35 + 5 * severe, "strong" if rep.quality["score"] < 70 else "medium" if rep.quality["score"] < 90 else "weak",
            f"Data quality {rep.quality['score']} of 100", f"{rep.quality['issues']} issues, {severe} severe; {rep.quality['duplicates']} repeated rows.")
    out.sort(key=lambda x: -x["score"])
    seen: set[tuple] = set()
    kept = []
    for x in out:
        key = x.pop("key")
        if key is None or key not in seen:
            seen.add(key) if key else None
            kept.append(x)
    return kept


def build_summary(rep: Report) -> str:
    types = [p["type"] for p in rep.profiles]
    cur = rep.type_of(rep.metric) == "currency"
    parts = [f"{rep.rows:,} rows in {len(types)} columns: {sum(t in ('number', 'currency', 'percent') for t in types)} numeric, {sum(t in ('category', 'boolean') for t in types)} categorical, {types.count('date')} dates."]
    if rep.domain:
        parts.append(f"The headers read like {rep.domain[1]} data ({', '.join(rep.domain[2][:4])}).")
    head = next((p for p in rep.profiles if p["column"] == rep.metric), None)
    if head:
        parts.append(f"Headline metric {rep.metric}: mean {show(head['mean'], cur)}, median {show(head['median'], cur)}, {show(head['min'], cur)} to {show(head['max'], cur)}.")
    mine = [d for d in rep.lists["drivers"] if d["metric"] == rep.metric]
    top = (mine or rep.lists["drivers"])[:1]
    for d in top:
        parts.append(f"{d['driver']} goes most with {d['metric']} (omega² {d['omega2']:.3f}, {show_p(d['p_adj'], 'q')}).")
    if len(mine) > 1:
        parts.append("Then come " + ", ".join(d["driver"] for d in mine[1:4]) + ".")
    for c in rep.lists["correlations"][:1]:
        parts.append(f"{c['a']} and {c['b']} move together (r = {c['r']:.2f}).")
    for fit in rep.lists.get("fit") or []:
        parts.append("There is no dependable trend." if fit["r2"] < 0.15 else f"The trend is {'up' if fit['slope'] > 0 else 'down'} (R² {fit['r2']:.2f}).")
    if not rep.lists["drivers"] and not rep.lists["correlations"] and not rep.lists["associations"] and rep.rows > 50:
        parts.append("No tested relation passed the adjusted thresholds.")
    parts.append(f"Data quality {rep.quality['score']} of 100; {len(rep.findings)} findings.")
    return " ".join(parts)


def build_actions(rep: Report) -> list[str]:
    out = []
    if rep.quality["score"] < 85:
        out.append(f"Clean the data first: quality is {rep.quality['score']} of 100.")
    ranked = sorted(rep.lists["drivers"], key=lambda d: d["metric"] != rep.metric)
    if ranked:
        out.append(f"Look into {ranked[0]['driver']} and {ranked[0]['metric']} (omega² {ranked[0]['omega2']:.2f}); test before acting on it.")
    if len(ranked) > 2 and ranked[0]["driver"] != ranked[1]["driver"]:
        out.append(f"Cross {ranked[0]['driver']} with {ranked[1]['driver']} in a pivot.")
    for a in [a for a in rep.lists["associations"] if a["v"] > 0.7][:1]:
        out.append(f"{a['a']} and {a['b']} may hold the same information (V {a['v']:.2f}).")
    weak = sum(abs(r["r"]) >= 0.15 and not (r["p_adj"] is not None and r["p_adj"] < 0.05) for r in rep.lists["correlations_all"])
    if weak:
        out.append(f"{weak} numeric pairs did not pass adjustment: treat them as exploratory.")
    high = sum(r["count"] for r in rep.lists.get("outlier_counts") or [] if r["severity"] == "high")
    if high:
        out.append(f"Check {high} values at four deviations and more one by one.")
    constant = [p["column"] for p in rep.profiles if p["constant"] and p["complete"] > 0]
    if constant:
        out.append(f"Constant columns can go: {', '.join(constant[:3])}.")
    for r in [r for r in rep.lists["correlations"] if r["nonlinear"]][:1]:
        out.append(f"{r['a']} and {r['b']} relate along a curve: check before fitting a line.")
    return out or ["No further steps suggest themselves."]
