"""Quality rules as a short-circuit cascade.

Cost and selectivity of each rule are measured on a bounded sample; rules then
run in the order of rejection per cost, each only on the documents that all
earlier ones let pass: what a rule alone asks for is never computed for others.
The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datascry.llm import annotate
from datascry.llm import words as w

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[0x61:0x7B] = True

#: Fixed list: English insults that mark abusive text.
FLAGGED = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive ``bounds``."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class Measures(w.Texts):
    """What the rules ask of some texts, each computed when first asked for."""

    @cached_property
    def rows_of_words(self) -> np.ndarray:
        return self.rows()

    @cached_property
    def codes(self) -> np.ndarray:
        return self.hashes()

    @cached_property
    def word_chars(self) -> np.ndarray:
        """Code points in words."""
        return _per_text(((self.data & 0xC0) != 0x80) & w.WORD[self.data], self.offsets)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return _per_text(_SYMBOL[self.data], self.offsets)

    @cached_property
    def n_lines(self) -> np.ndarray:
        """Lines with a word."""
        return self._lines[0]

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of the text."""
        return self._lines[1]

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        breaks = np.flatnonzero(self.data == 0x0A)
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]))
        rows = np.searchsorted(self.offsets, starts, "right") - 1
        # a break that ends a text starts no line of the next one, but an empty line of its own
        rows = np.clip(rows, 0, len(self) - 1)
        ends = np.minimum(np.append(starts[1:], len(self.data)), self.offsets[rows + 1])
        closed = np.isin(ends - 1, breaks)
        ends = np.where((ends > starts) & closed, ends - 1, ends)
        worded = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
        rows, starts, ends = rows[worded], starts[worded], ends[worded]
        n = np.bincount(rows, minlength=len(self))
        codes = self.spans(starts, ends)
        return n, n - _distinct(rows, codes, len(self))

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words in 3-word windows that the text has twice or more."""
        gram = w.grams(self.codes, 3)
        at = np.flatnonzero(w.whole(self.first, len(gram), 3))
        key = _in_text(self.rows_of_words[at], gram[at])
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        starts = at[twice]
        return _per_text(w.covered(len(self.starts), starts, starts + 3), self.first)

    @cached_property
    def n_upper(self) -> np.ndarray:
        return _per_text(_UPPER[self.data], self.offsets)

    @cached_property
    def n_lower(self) -> np.ndarray:
        return _per_text(_LOWER[self.data], self.offsets)

    def n_flagged(self, codes: np.ndarray) -> np.ndarray:
        """Words among ``codes`` once lower-cased and stripped of ASCII punctuation."""
        trimmed = w.Texts(self.data, self.offsets, w.ALNUM, lower=True)
        return _per_text(np.isin(trimmed.hashes(), codes), trimmed.first)

    def take(self, chosen: np.ndarray) -> Measures:
        """The same for the texts that ``chosen`` flags, with what is measured already."""
        size, n = np.diff(self.offsets), self.n_words
        inside = np.repeat(chosen, size)
        by_word = np.repeat(chosen, n)
        out = object.__new__(Measures)
        out.data = self.data[inside]
        out.offsets = np.concatenate([[0], np.cumsum(size[chosen])])
        moved = np.repeat((self.offsets[:-1][chosen] - out.offsets[:-1]), n[chosen])
        out.starts, out.ends = self.starts[by_word] - moved, self.ends[by_word] - moved
        out.first = np.concatenate([[0], np.cumsum(n[chosen])])
        for name, held in self.__dict__.items():
            if name == "codes":
                out.codes = held[by_word]
            elif name == "_lines":
                out._lines = tuple(x[chosen] for x in held)
            elif name in ("word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower"):
                setattr(out, name, held[chosen])
        return out


def _in_text(rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return codes ^ w._mixed(rows.astype(np.uint64) + np.uint64(1))


def _distinct(rows: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """Distinct codes of each text."""
    pairs = np.unique(np.rec.fromarrays([rows, codes])) if len(rows) else np.rec.fromarrays([rows, codes])
    return np.bincount(pairs["f0"], minlength=n)


def _codes_of(names: Sequence[str]) -> np.ndarray:
    data = [x.encode() for x in names]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    return w.Texts(np.frombuffer(b"".join(data), dtype=np.uint8), offsets, w.ALNUM).hashes()



@dataclass(frozen=True)
class Rule:
    """``rejects`` gives a flag for each text of some :class:`Measures`."""

    name: str
    rejects: Callable[[Measures], np.ndarray]


def flagged_rule(names: Sequence[str], least: int = 1) -> Rule:
    """Rejects texts with ``least`` or more flagged words."""
    codes = _codes_of(sorted(set(names)))
    return Rule("flagged_words", lambda m: m.n_flagged(codes) >= least)


#: The production rules; thresholds are per document and exact integers.
RULES = (
    Rule("few_words", lambda m: m.n_words < 50),
    Rule("word_length", lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 20 * m.n_words)),
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("capitals", lambda m: (m.n_upper > m.n_lower) & (m.n_upper > 20)),
    Rule("duplicate_lines", lambda m: 10 * m.n_dup_lines > 6 * m.n_lines),
    Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
    flagged_rule(FLAGGED),
)


def with_flagged(names: Sequence[str], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """``rules`` with more flagged words than the fixed list."""
    return tuple(flagged_rule([*FLAGGED, *names]) if r.name == "flagged_words" else r for r in rules)


def learn_flagged(
    docs: DataFrame, labels: DataFrame, rows: int = 12_000, least_docs: int = 8, purity: float = 0.97, most: int = 500
) -> list[str]:
    """Words that mark toxic documents, from a bounded sample of labelled rows.

    The ``rows`` labels of least MD5 of the id are used.  A word is flagged if it is
    in at least ``least_docs`` sampled documents and a share ``purity`` of them
    is toxic; of more than ``most``, those in most documents.
    """
    picked = (
        labels.filter("doc_id is not null and toxic is not null")
        .select("doc_id", (F.col("toxic") == 1).alias("toxic"))
        .orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id", "toxic")
        .limit(rows)
    )
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    said = F.array_distinct(F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)")))
    counted = (
        docs.select("doc_id", "text")
        .join(F.broadcast(picked), "doc_id")  # at most ``rows`` ids
        .select("toxic", F.explode(said).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("toxic").cast("long")).alias("toxic"))
        .filter((F.col("n") >= least_docs) & (F.col("toxic") >= purity * F.col("n")))
        .orderBy(F.desc("n"), "word")
        .limit(most)
    )
    return [r[0] for r in counted.select("word").collect()]


def cascade(measures: Measures, rules: tuple[Rule, ...], failed: np.ndarray | None = None) -> np.ndarray:
    """Which texts no rule rejects, of those that have not ``failed`` before.

    A rule is computed for the texts alone that all earlier ones let pass.
    """
    kept = np.ones(len(measures), dtype=bool) if failed is None else ~failed
    part = measures if kept.all() else measures.take(kept)
    for rule in rules:
        if not len(part):
            break
        bad = rule.rejects(part)
        if bad.any():
            kept[np.flatnonzero(kept)[bad]] = False
            part = part.take(~bad)
    return kept


def order_rules(sample: list[str], rules: tuple[Rule, ...] = RULES) -> tuple[tuple[Rule, ...], list[dict]]:
    """Rules by estimated rejection per cost on ``sample``, with the estimates.

    Each rule is timed alone on fresh measures.  Ties keep the given order.
    """
    report = []
    column = pa.array(sample, pa.string())
    for rule in rules:
        cost, rejected, seen = 0.0, 0, 0
        for _, _, data, offsets in w.chunks(column):
            measures = Measures(data, offsets)
            measures.codes  # noqa: B018  word hashes are shared by several rules
            began = time.thread_time()
            rejected += int(np.count_nonzero(rule.rejects(measures)))
            cost += time.thread_time() - began
            seen += len(measures)
        report.append({"rule": rule.name, "cost": cost / max(seen, 1), "rejects": rejected / max(seen, 1)})
    ranked = sorted(range(len(rules)), key=lambda i: -report[i]["rejects"] / max(report[i]["cost"], 1e-9))
    return tuple(rules[i] for i in ranked), [report[i] for i in ranked]


def sample_texts(docs: DataFrame, rows: int = 512, most_chars: int = 1 << 24) -> list[str]:
    """About ``rows`` texts at most, those of least hash of the id: the same for the
    same table.

    The lengths of the least hashes come first; the sample ends where they add
    up to ``most_chars``, so what reaches the driver is bounded both ways.  Only
    estimates depend on it.
    """
    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    least = docs.select(order.alias("h"), F.coalesce(F.length("text"), F.lit(0)).alias("chars")).orderBy("h", "chars").limit(rows).collect()
    total, last = 0, None
    for row in least:
        total += row.chars
        if total > most_chars:
            break
        last = row.h
    if last is None:
        return []
    return [row[0] or "" for row in docs.filter((order <= last) & (F.coalesce(F.length("text"), F.lit(0)) <= most_chars)).select("text").limit(rows).toLocalIterator()]


FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean"
)


def _rated(column: pa.Array, rules: tuple[Rule, ...], verdict_only: bool) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = []
    for _, _, data, offsets in w.chunks(column):
        m = Measures(data, offsets)
        if verdict_only:
            out.append([cascade(m, rules)])
            continue
        # the measures that are columns are wanted for all texts, what else rules ask for only where they still run
        base = [m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words]
        failed = (m.n_words < 50) | (100 * m.n_repeat_words > 50 * m.n_words)
        out.append([*base, failed, cascade(m, rules, failed)])
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def rate(docs: DataFrame, keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES, sample_rows: int = 512) -> DataFrame:
    """``docs`` (columns ``keep``) with their base measures and the verdict ``kept``.

    Words are ``[^\\x20\\x09-\\x0D]+``.  ``base_failed``: under 50 words, or more
    than half of them in repeated 3-word windows.  Null and empty texts have
    no words and fail.  Repeated rows are rated alike; an empty table gives no
    rows; clashing new columns get leading underscores.
    """
    ordered, _ = order_rules(sample_texts(docs, sample_rows), rules)
    return annotate.add_columns(docs, "text", lambda c: _rated(c, ordered, False), FIELDS, keep)


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 512) -> DataFrame:
    """The documents that no rule rejects, their columns unchanged.

    Only what the rules ask for is computed.
    """
    ordered, _ = order_rules(sample_texts(docs, sample_rows), rules)
    rated = annotate.add_columns(docs, "text", lambda c: _rated(c, ordered, True), "kept boolean")
    return rated.filter(F.col(rated.columns[-1])).select(*[annotate._quoted(c) for c in docs.columns])
