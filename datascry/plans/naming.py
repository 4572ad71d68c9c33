"""What column names say: the domain of a table, known KPIs, the headline metric."""

from __future__ import annotations

import re
from collections.abc import Sequence

# Domains and the words in headers that point to them.
DOMAINS = (
    ("insurance", "Insurance / Actuarial", ("premium", "policy", "claim", "insured", "deductible", "underwriting", "coverage", "telematics", "territory", "peril", "loss ratio", "renewal")),
    ("finance", "Finance / Accounting", ("revenue", "expense", "invoice", "balance", "debit", "credit", "account", "transaction", "cash", "profit", "margin", "budget")),
    ("sales", "Sales / Commercial", ("revenue", "units", "order", "quantity", "discount", "customer", "deal", "pipeline", "quota", "churn", "arr", "mrr")),
    ("marketing", "Marketing / Growth", ("ad spend", "impression", "click", "ctr", "cpc", "conversion", "campaign", "channel", "roas", "lead", "traffic")),
    ("hr", "HR / Workforce", ("employee", "salary", "tenure", "attrition", "headcount", "department", "hire", "performance rating", "absence")),
    ("ops", "Operations / Supply chain", ("inventory", "sku", "warehouse", "shipment", "lead time", "defect", "downtime", "throughput", "supplier", "fulfil")),
    ("realestate", "Real estate / Property", ("rent", "property", "tenant", "occupancy", "square", "sqft", "lease", "valuation", "mortgage")),
    ("education", "Education", ("student", "grade", "course", "enrol", "attendance", "score", "teacher", "gpa")),
)

# Name patterns of known KPIs, first match wins, and which way is better.
KPIS = (
    (r"(loss ratio)", "Loss ratio", "lower"),
    (r"(premium)", "Premium", "higher"),
    (r"(claim.*(amount|paid|severity)|severity)", "Claim severity", "lower"),
    (r"(claim.*(count|frequency|number)|accident freq)", "Claim frequency", "lower"),
    (r"(lifetime value|clv|ltv)", "Customer lifetime value", "higher"),
    (r"(conversion|win rate|close rate)", "Conversion rate", "higher"),
    (r"(churn|attrition|lapse)", "Churn / lapse", "lower"),
    (r"(retention|renewal rate|loyalty)", "Retention", "higher"),
    (r"(revenue|sales|turnover|gross)", "Revenue", "higher"),
    (r"(profit|margin|net income|ebitda)", "Profit / margin", "higher"),
    (r"(cost|expense|spend|opex|cogs)", "Cost", "lower"),
    (r"(credit score|fico)", "Credit score", "higher"),
    (r"(mileage|miles|distance)", "Mileage / exposure", "neutral"),
    (r"(tenure|years as|years with|seniority)", "Tenure", "higher"),
    (r"(satisfaction|nps|csat|rating|score)", "Satisfaction / rating", "higher"),
    (r"(occupancy)", "Occupancy", "higher"),
    (r"(defect|error|failure|downtime|complaint|violation|suspension)", "Defects / violations", "lower"),
    (r"(units|quantity|volume|count)", "Volume", "higher"),
    (r"(discount)", "Discount", "lower"),
    (r"(age)", "Age", "neutral"),
    (r"(income|salary|wage)", "Income", "higher"),
)

# Names of headline metrics, by priority.
METRICS = (
    r"premium", r"loss ratio", r"revenue|sales|turnover", r"profit|margin", r"claim.*(amount|paid|severity)", r"lifetime value|clv|ltv",
    r"amount|total|value", r"cost|expense|spend", r"price", r"score",
)


def detect_domain(columns: Sequence[str]) -> tuple[str, str, list[str]] | None:
    """Id, label and matched words of the domain with most of them; ties keep the first."""
    header = " | ".join(c.lower() for c in columns)
    hits = [(d, label, [w for w in words if w in header]) for d, label, words in DOMAINS]
    best = max(hits, key=lambda h: len(h[2]))
    return best if best[2] else None


def classify_kpi(name: str) -> tuple[str, str] | None:
    """Label and better direction of the first KPI whose pattern is in the name."""
    return next(((label, better) for pattern, label, better in KPIS if re.search(pattern, name, re.I)), None)


def pick_metric(candidates: Sequence[dict]) -> str | None:
    """The headline of numeric profiles (``column, type, cv``) in file order: by
    name, else the money column, or any, that varies most."""
    for pattern in METRICS:
        for c in candidates:
            if re.search(pattern, c["column"], re.I):
                return c["column"]
    money = [c for c in candidates if c["type"] == "currency"]
    return max(money or candidates, key=lambda c: c["cv"] or 0.0, default={"column": None})["column"]
