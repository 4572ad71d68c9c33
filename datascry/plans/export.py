"""A report as one HTML page, as JSON, or its frames as tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from datascry.plans.analyse import Report
from datascry.plans.findings import escape


def to_json(rep: Report) -> str:
    body = {"rows": rep.rows, "types": rep.types, "metric": rep.metric, "domain": rep.domain, "quality": rep.quality, "summary": rep.summary, "strip": rep.strip,
            "findings": rep.findings, "actions": rep.actions, "profiles": rep.profiles, "lists": rep.lists}
    return json.dumps(body, default=str, ensure_ascii=False, indent=1)


def _table(rows: list[dict]) -> str:
    if not rows:
        return "<p>none</p>"
    names = list(rows[0])
    head = "".join(f"<th>{escape(n)}</th>" for n in names)
    body = "".join("<tr>" + "".join(f"<td>{escape(r.get(n))}</td>" for n in names) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def to_html(rep: Report, sample: DataFrame | None = None, rows: int = 200) -> str:
    """Summary, findings, steps, every list, and the first ``rows`` rows of ``sample``."""
    cards = "".join(f"<li><b>{escape(c['label'])}</b> {escape(c['value'])} <small>{escape(c['sub'])}</small></li>" for c in rep.strip)
    parts = [f"<h1>Report</h1><p>{escape(rep.summary)}</p><ul>{cards}</ul>", "<h2>Findings</h2>"]
    parts += [f"<h3>{escape(f['title'])}</h3><p>{escape(f['body'])}</p>" for f in rep.findings]
    parts.append("<h2>Next steps</h2><ul>" + "".join(f"<li>{escape(a)}</li>" for a in rep.actions) + "</ul>")
    parts += [f"<h2>{escape(name)}</h2>{_table(found)}" for name, found in rep.lists.items()]
    if sample is not None:
        parts.append("<h2>Rows</h2>" + _table([r.asDict() for r in sample.limit(rows).collect()]))
    return "<!DOCTYPE html><meta charset=utf-8><title>Report</title>" + "".join(parts)


def write_frames(rep: Report, path: str) -> None:
    """Each frame as Parquet under ``path``."""
    for name, frame in rep.frames.items():
        frame.write.mode("overwrite").parquet(f"{path}/{''.join(c if c.isalnum() else '_' for c in name)}")
