"""What a page shows beside the findings: the strip of headline figures, axis ticks."""

from __future__ import annotations

import math
from typing import TYPE_CHECKING

from datascry.plans.findings import shorten, show

if TYPE_CHECKING:
    from datascry.plans.analyse import Report


def show_pct(v: float | None, digits: int = 1) -> str:
    return "—" if v is None or not math.isfinite(v) else f"{v:.{digits}f}%"


def show_day(day: object) -> str:
    return "—" if day is None else str(day)[:10]


def axis_ticks(least: float, most: float, count: int = 5) -> list[float]:
    """Round numbers from ``least`` to ``most``, about ``count``: steps are 1, 2, 5 or 10
    times a power of ten, the next above the even share."""
    if not (math.isfinite(least) and math.isfinite(most)):
        return [0.0, 1.0]
    if least == most:
        least, most = least - 1, most + 1
    share = (most - least) / count
    unit = 10.0 ** math.floor(math.log10(share))
    step = unit * next((s for s in (1, 2, 5) if share / unit < s), 10)
    first = math.ceil(least / step - 1e-6)
    return [round(k * step, 10) for k in range(first, math.floor(most / step + 1e-6) + 1)]


def projection(rep: Report) -> dict | None:
    """Change from the fitted value at the last day to the end of the forecast."""
    fit = (rep.lists.get("fit") or [None])[0]
    ahead = rep.lists.get("forecast") or []
    if not fit or not ahead:
        return None
    base = fit["slope"] * (fit["last"] - fit["first"]).days + fit["intercept"]
    end = max(ahead, key=lambda r: r["day"])["value"]
    change = (end - base) / abs(base) * 100 if abs(base) > 1e-9 else 0.0
    return {"r2": fit["r2"], "steps": len(ahead), "change_pct": change, "dependable": fit["r2"] >= 0.15}


def kpi_strip(rep: Report) -> list[dict]:
    """Headline figures as ``label, value, sub, tone``."""
    cards = []

    def card(label: str, value: str, sub: str, tone: str = "") -> None:
        cards.append({"label": label, "value": value, "sub": sub, "tone": tone})

    q = rep.quality
    card("Rows", f"{rep.rows:,}", f"{len(rep.profiles)} columns")
    card("Data quality", f"{q['score']}/100", f"{q['issues']} issues", "good" if q["score"] >= 90 else "fair" if q["score"] >= 70 else "poor")
    drivers = rep.lists["drivers"]
    for d in [x for x in drivers if x["metric"] == rep.metric][:1] or drivers[:1]:
        card("Top association", shorten(d["driver"], 22), f"omega² {d['omega2']:.2f}, {shorten(d['metric'], 16)}", "accent")
    for c in rep.lists["correlations"][:1]:
        card("Strongest link", f"{c['r']:+.2f}", f"{shorten(c['a'], 12)} and {shorten(c['b'], 12)}", "accent")
    counts = {r["severity"]: r["count"] for r in rep.lists.get("outlier_counts") or []}
    card("Outliers", f"{sum(counts.values()):,}", f"{counts.get('high', 0):,} extreme", "fair" if counts else "good")
    ahead = projection(rep)
    if ahead:
        said = f"{ahead['change_pct']:+.1f}%" if ahead["dependable"] else "no trend"
        card("Projection", said, f"R² {ahead['r2']:.2f}, {ahead['steps']} steps, against the trend", ("good" if ahead["change_pct"] >= 0 else "poor") if ahead["dependable"] else "")
    head = next((p for p in rep.profiles if p["column"] == rep.metric), None)
    if head:
        cur = rep.type_of(rep.metric) == "currency"
        card(f"Median {shorten(rep.metric, 16)}", show(head["median"], cur), f"mean {show(head['mean'], cur)}")
    return cards
