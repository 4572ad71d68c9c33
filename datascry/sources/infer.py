"""Semantic types of columns and the sensitive-data scan."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascry.functions import values as V

NUMERIC = ("number", "currency", "percent")
GROUPABLE = ("category", "boolean")
# Patterns of column names.
_CODE = re.compile(r"(^|[\s_-])(zip|zipcode|postal|postalcode|code)([\s_-]|$)")
_ID = re.compile(r"(^|[\s_-])(id|identifier|uuid|guid|mrn|record\s*(number|no)|account\s*(number|no)|customer\s*(number|no))([\s_-]|$)")
_YEAR = re.compile(r"(^|[\s_-])year([\s_-]|$)")
_MONEY = re.compile(r"price|amount|cost|revenue|premium|spend|paid|income|salary|value|fee|charge|balance")


def type_by_name(name: str) -> str | None:
    low = name.lower()
    return "category" if _CODE.search(low) else "id" if _ID.search(low) else None


def infer_types(df: DataFrame, columns: Sequence[str] | None = None, types: Mapping[str, str] | None = None) -> dict[str, str]:
    """Semantic type of each column; ``types`` overrides.

    All values count, not a sample.  Names decide first, then the share of
    cells that read as dates, money, percentages, booleans or numbers, then
    how many distinct values there are.  Native numbers and times need no
    patterns; of other cells equal ones are counted first, and patterns see each text once.
    """
    names = [c for c in columns or df.columns if c != "_row"]
    out = {c: t for c in names if (t := type_by_name(c))}
    open_ = [c for c in names if c not in out]
    kinds_of = {c: df.schema[c].dataType for c in open_}
    native = [c for c in open_ if isinstance(kinds_of[c], T.NumericType)]
    timed = [c for c in open_ if isinstance(kinds_of[c], (T.DateType, T.TimestampType, T.TimestampNTZType))]
    worded = [c for c in open_ if c not in native and c not in timed]
    measured = {c: dict.fromkeys(("n", "date", "currency", "percent", "boolean", "number", "folded", "distinct"), 0) for c in open_}
    if native or timed:
        plain = [F.struct(F.count(f"`{c}`").alias("n"), F.count_if(F.col(f"`{c}`").isin(0, 1) if c in native else F.lit(False)).alias("binary")) for c in native + timed]
        seen = df.agg(*[x.alias(f"s{i}") for i, x in enumerate(plain)]).first()
        for i, c in enumerate(native + timed):
            measured[c] |= {"n": seen[i].n, "number": seen[i].n, "boolean": seen[i].binary} if c in native else {"n": seen[i].n, "date": seen[i].n}
    if worded:
        # cells one under another: the patterns are in the plan once, however many columns there are
        cells = [F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("cell"), F.lit(isinstance(kinds_of[c], T.StringType)).alias("text")) for i, c in enumerate(worded)]
        same = df.select(F.inline(F.array(*cells))).filter("cell is not null").groupBy("i", "text", "cell").agg(F.count(F.lit(1)).alias("m"))
        texts = same.select("i", "text", V.trimmed(F.col("cell")).alias("said"), "m").filter("said <> ''").groupBy("i", "text", "said").agg(F.sum("m").alias("m"))
        said = F.col("said")
        hits = {
            "n": F.lit(True),
            "date": F.col("text") & V.parse_date(said).isNotNull(),
            "currency": said.rlike(V.CURRENCY),
            "percent": said.rlike(V.PERCENT),
            "boolean": F.lower(said).isin(*V.BOOLEANS),
            "number": said.rlike(V.NUMBER),
        }
        # without case, then of each column: two countings of distinct texts
        folds = texts.groupBy("i", F.lower(said).alias("low")).agg(F.count(F.lit(1)).alias("k"), *[F.sum(F.when(v, F.col("m")).otherwise(0)).alias(h) for h, v in hits.items()])
        each = folds.groupBy("i").agg(F.count(F.lit(1)).alias("folded"), F.sum("k").alias("distinct"), *[F.sum(h).alias(h) for h in hits])
        measured |= {worded[r.i]: r.asDict() for r in each.collect()}  # a row for each column

    def distinct(asked: Sequence[tuple[str, bool]]) -> dict[str, int]:
        """How many values each column has; with ``True``, without case."""
        known = {c: measured[c]["folded" if fold else "distinct"] for c, fold in asked if c in worded}
        counted = [(c, fold) for c, fold in asked if c not in known]
        values = [(V.trimmed(F.col(f"`{c}`")), fold) for c, fold in counted]
        folded = [F.lower(v) if fold else v for v, fold in values]
        if not folded:
            return known
        cells = F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(folded)])
        counts = df.select(F.inline(cells)).filter("v <> ''").distinct().groupBy("i").agg(F.count(F.lit(1)).alias("k")).collect()
        return known | {counted[r.i][0]: r.k for r in counts}

    def settled(s: Mapping[str, int]) -> bool:
        return not s["n"] or s["date"] > 0.85 * s["n"] or s["currency"] > 0.7 * s["n"] or s["percent"] > 0.7 * s["n"]

    def yearly(c: str) -> bool:
        return bool(_YEAR.search(c.lower()))

    unsettled = {c: s for c, s in measured.items() if not settled(s)}
    flags = distinct([(c, True) for c, s in unsettled.items() if s["boolean"] > 0.9 * s["n"]])
    flags = {c for c, k in flags.items() if k <= 3}
    kinds = distinct([(c, False) for c, s in unsettled.items() if c not in flags and (yearly(c) or s["number"] <= 0.85 * s["n"])])
    for c, s in measured.items():
        n, low = s["n"], c.lower()
        if not n:
            out[c] = "text"
        elif s["date"] > 0.85 * n:
            out[c] = "date"
        elif s["currency"] > 0.7 * n:
            out[c] = "currency"
        elif s["percent"] > 0.7 * n:
            out[c] = "percent"
        elif c in flags:
            out[c] = "boolean"
        elif s["number"] > 0.85 * n:
            if yearly(c) and kinds[c] < 0.95 * n:
                out[c] = "category"
            else:
                out[c] = "currency" if _MONEY.search(low) else "number"
        else:
            k = kinds[c]
            out[c] = "category" if k <= 60 or k < 0.35 * n else "id" if k > 0.9 * n and n > 20 else "text"
    return {c: (types or {}).get(c, out[c]) for c in names}


# ------------------------------------------------------------ sensitive data

# Terms of the scan, as patterns.
STRONG = (
    "icd-?9", "icd-?10", "icd-?11", "cpt code", "hcpcs", "snomed", "npi number", "medical record (number|no|#)?", "mrn", "patients?",
    "patient (name|id|identifier)", "protected health information", "phi", "ephi", "discharge summary", "physician note", "clinical note",
    "health plan beneficiary", "treatment plan", "lab result", "prescription", "dosage", "medication",
)
WEAK = (
    "diagnosis", "diagnoses", "symptom", "blood pressure", "cholesterol", "immunization", "immunisation", "vaccination", "clinical", "hospital",
    "admission date", "discharge", "allergy", "allergies", "insulin", "bmi", "systolic", "diastolic",
)
EDUCATION = r"(?i)\b(student|pupil|grade|gpa|semester|teacher|classroom|homeroom|attendance|enrol|course|school|district|transcript|iep|504)\b"
DECLARED = (
    r"(?i)\b(no phi|no-phi|nophi|de-?identified|deidentified|synthetic|anonymi[sz]ed|test data|dummy data|sample data|not phi|contains no phi|phi[- ]free)\b"
)


def _bounded(term: str) -> str:
    return f"(?i)(^|[^a-z0-9])({term})([^a-z0-9]|$)"


def health_scan(df: DataFrame) -> dict:
    """Whether headers or cells suggest health records.

    Strong terms are looked for in headers and in every row, weak ones in
    headers alone: two of them block, three where headers speak of schooling.
    A declaration that the data are made up is reported, and overrides nothing.
    """
    columns = [c for c in df.columns if c != "_row"]
    header = " | ".join(columns)
    row = F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in columns])
    seen = df.select(row.alias("said")).agg(
        *[F.coalesce(F.max(F.col("said").rlike(_bounded(t))), F.lit(False)).alias(f"s{i}") for i, t in enumerate(STRONG)],
        F.coalesce(F.max(F.col("said").rlike(DECLARED)), F.lit(False)).alias("declared"),
    ).first()
    strong = [t for i, t in enumerate(STRONG) if seen[f"s{i}"] or re.search(_bounded(t), header)]
    weak = [t for t in WEAK if re.search(_bounded(t), header)]
    education = bool(re.search(EDUCATION, header))
    return {
        "blocked": bool(strong) or len(weak) >= (3 if education else 2),
        "terms": [re.sub(r"[-?()]", lambda m: "" if m.group() == "?" else m.group(), t) for t in [*strong, *weak]],
        "strong": len(strong),
        "weak": len(weak),
        "education": education,
        "declared": bool(seen["declared"] or re.search(DECLARED, header)),
    }
