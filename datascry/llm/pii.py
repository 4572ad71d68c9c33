"""Personal data by patterns and a semi-Markov conditional random field.

The patterns give the base spans.  The model looks at the rest: tokens around
digits, ``@`` signs and spelled-out ``at``/``dot`` form short lattices in which
whole candidate segments are scored by features of the whole span, and a dynamic
programme with bounded segment length chooses boundaries and types jointly.
Base spans stay as they are; the model adds spans that overlap none of them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from datascry.llm import annotate

KINDS = ("email", "ip", "card", "phone")
#: The patterns below give the matches of these, but read no run of characters
#: again from each of its places:
#: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``, ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)``,
#: ``[0-9]([\x20-]?[0-9])+`` and ``\+[0-9][\x20().0-9-]+[0-9]``.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NON_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def octet(digits: str) -> bool:
    """Whether a run of digits of any length is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


Span = tuple[int, int, int]  # kind, start, end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the pattern of addresses: back over the run before each at-sign,
    on through the host after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        host = _HOST.match(text, at + 1) if start < at else None
        free = host.end() if host else at + 1
        if host:
            yield start, free
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """Pattern matches by kind, then start: leftmost, non-overlapping per kind;
    a match that fails its check is dropped without a second try."""
    out: list[Span] = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(octet(p) for p in m.group().split(".")):
                    out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = _NON_DIGIT.sub("", m.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_NON_DIGIT.sub("", m.group())) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


# ------------------------------------------------------------------ the model

#: Tokens: runs of digits, runs of letters, or single other characters.
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]")
#: Where a lattice is worth building: digit groups that could make an address
#: or number, at-signs, and an at or dot spelled out within brackets.
_CUE = re.compile(
    r"[0-9]{2,}[ .\x2d()/_]{1,3}[0-9]{2,}|[0-9]{1,3}(?:\s?[\[(]?\.[\])]?\s?[0-9]{1,3}){3}|[0-9]{9,}|@"
    r"|[(\[{<](?:at|AT|dot|DOT)[)\]}>]| (?:at|AT) [A-Za-z0-9-]+ (?:dot|DOT) "
)
MOST_TOKENS = 16
#: Fixed words that stand for @ and . in disguised addresses.
_AT, _DOT = {"at", "@"}, {"dot", "."}


def _known_label(word: str) -> str:
    low = word.lower()
    if low in ("phone", "tel", "telephone", "call", "fax", "mobile", "cell"):
        return "phone"
    if low in ("mail", "email", "contact", "reach"):
        return "email"
    if low in ("card", "visa", "mastercard", "amex", "credit"):
        return "card"
    if low in ("ip", "host", "server", "address", "addr"):
        return "ip"
    return ""


def segment_features(text: str, tokens: Sequence[tuple[int, int]], i: int, j: int) -> list[str]:
    """Features of the segment of tokens i to j (exclusive) as a whole."""
    start, end = tokens[i][0], tokens[j - 1][1]
    said = text[start:end]
    words = [text[a:b] for a, b in tokens[i:j]]
    runs = [x for x in words if x.isdecimal() and x.isascii()]
    digits = "".join(runs)
    out = []
    shape = re.sub(r"[0-9]+", lambda m: "d%d" % min(len(m.group()), 5), re.sub(r"[^\W\d_]+", "w", said))
    if len(shape) <= 24:
        out.append("shape=" + shape)
    out.append("digits=%d" % min(len(digits), 20))
    out.append("runs=%d" % min(len(runs), 6))
    out.append("edges=" + ("d" if words[0].isdecimal() else "w" if words[0].isalpha() else words[0]) + ("d" if words[-1].isdecimal() else "w" if words[-1].isalpha() else words[-1]))
    low = [x.lower() for x in words]
    ats = sum(x in _AT for x in low)
    dots = sum(x in _DOT for x in low)
    letters = sum(x.isalpha() for x in words)
    if ats == 1 and dots and letters > 1:
        k = next(n for n, x in enumerate(low) if x in _AT)
        tail = [x for x in low[k + 1 :] if x.isalpha() and x not in _DOT]
        tidy = bool(tail) and 2 <= len(tail[-1]) <= 4 and any(x in _DOT for x in low[k + 1 :])
        bracket = any(x in "([{<" for x in words)
        out.append("address=%d%d" % (tidy, bracket or "@" in words))
        out.append("local=%d" % (0 < k and words[0].isalnum()))
        out.append("local-gap=%d" % (" " in text[start : tokens[i + k][0]].strip(" ([{<")))
        rest = re.sub(r"\b(?:dot|DOT)\b", ".", text[tokens[i + k][1] : end])
        out.append("tail-gap=%d" % bool(re.search(r"[^\W_]\s+[^\W_]", rest)))
        out.append("ends-dot=%d" % (low[-1] in _DOT))
    if len(runs) == 4 and dots == 3 and not letters:
        out.append("octets=%d" % all(len(r) < 4 and int(r) <= 255 for r in runs))
    if 16 <= len(digits) <= 19 and not letters:
        out.append("luhn=%d" % luhn(digits))
        out.append("grouped=%d" % (len(runs) > 1 and all(len(r) == 4 for r in runs[:-1])))
    if 8 <= len(digits) <= 15 and not letters and len(runs) > 1:
        out.append("number=%d%d" % (len(runs), "." in words or "-" in words or "(" in words))
    if start and not text[start - 1].isspace() and text[start - 1] not in "\"'([{<:;,|=":
        out.append("glued-left")
    if end < len(text) and not text[end].isspace() and text[end] not in "\"'.,;:)]}>|!?":
        out.append("glued-right")
    if said.count("(") != said.count(")"):
        out.append("unbalanced")
    before = re.findall(r"[^\W\d_]+", text[max(0, start - 24) : start])
    label = _known_label(before[-1]) if before else ""
    if label:
        out.append("after=" + label)
    return out


def lattice_windows(text: str, taken: Sequence[Span], reach: int = 48) -> list[tuple[int, int]]:
    """Stretches around cues that base spans do not cover, merged where they meet."""
    out: list[list[int]] = []
    spans = sorted((a, b) for _, a, b in taken)
    starts = [a for a, _ in spans]
    reached = list(accumulate((b for _, b in spans), max))
    for m in _CUE.finditer(text):
        before = bisect_right(starts, m.start())
        if before and m.end() <= reached[before - 1]:
            continue
        lo, hi = max(0, m.start() - reach), min(len(text), m.end() + reach)
        lo = text.rfind("\n", lo, m.start()) + 1 or lo
        stop = text.find("\n", m.end(), hi)
        hi = hi if stop < 0 else stop
        while lo > 0 and lo < m.start() and text[lo - 1].isalnum() and text[lo].isalnum():
            lo += 1
        while m.end() < hi < len(text) and text[hi - 1].isalnum() and text[hi].isalnum():
            hi -= 1
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


@dataclass
class Model:
    """Weights by kind and feature; a segment outside weighs nothing."""

    weights: list[dict[str, float]]

    def scores(self, features: Sequence[str]) -> list[float]:
        return [sum(w.get(f, 0.0) for f in features) + w.get("bias", 0.0) for w in self.weights]


def _candidates(text: str, tokens: list[tuple[int, int]], taken: Sequence[Span]) -> dict[tuple[int, int], list[str]]:
    """Segments of at most :data:`MOST_TOKENS` tokens that may be entities: they
    begin and end with an alphanumeric (or an opening bracket or plus), have
    a digit or an at-sign word, hold no wide gap and overlap no base span.

    A segment without any structural feature can be no entity of ours: it needs
    an at and a dot between letters, four numbers with three dots, or 8 to 19
    digits without letters.
    """
    out = {}
    if not tokens:
        return out
    near = [(p, q) for _, p, q in taken if p < tokens[-1][1] and tokens[0][0] < q]
    words = [text[a:b] for a, b in tokens]
    digits = [len(x) if x.isdecimal() and x.isascii() else 0 for x in words]
    letters = [x.isalpha() for x in words]
    ats = [x.lower() in _AT for x in words]
    dots = [x.lower() in _DOT for x in words]
    for i, (a, _) in enumerate(tokens):
        if not (text[a].isalnum() or text[a] in "(+"):
            continue
        n_digits = n_runs = n_letters = n_ats = n_dots = 0
        for j in range(i + 1, min(len(tokens), i + MOST_TOKENS) + 1):
            x, y = tokens[j - 1]
            if j - 1 > i and x - tokens[j - 2][1] > 1:
                break
            if near and any(p < y and a < q for p, q in near):
                break
            n_digits += digits[j - 1]
            n_runs += digits[j - 1] > 0
            n_letters += letters[j - 1]
            n_ats += ats[j - 1]
            n_dots += dots[j - 1]
            if not words[j - 1].isalnum():
                continue
            address = n_ats == 1 and n_dots > 0 and n_letters > 1
            number = not n_letters and (16 <= n_digits <= 19 or (8 <= n_digits <= 15 and n_runs > 1))
            if address or number or (n_runs == 4 and n_dots == 3 and not n_letters):
                out[i, j] = segment_features(text, tokens, i, j)
    return out


def decode(text: str, lo: int, hi: int, taken: Sequence[Span], model: Model) -> list[Span]:
    """The best segmentation of ``text[lo:hi]``."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, lo, hi)]
    found = _candidates(text, tokens, taken)
    if not found:
        return []
    ending: dict[int, list[tuple[int, int, float]]] = {}
    for (i, j), features in found.items():
        for kind, score in enumerate(model.scores(features)):
            if score > 0:
                ending.setdefault(j, []).append((i, kind, score))
    best = [0.0] * (len(tokens) + 1)
    back: list[tuple[int, int] | None] = [None] * (len(tokens) + 1)
    for j in range(1, len(tokens) + 1):
        best[j] = best[j - 1]
        for i, kind, score in ending.get(j, ()):
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, kind)
    out, j = [], len(tokens)
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            out.append((kind, tokens[i][0], tokens[j - 1][1]))
            j = i
    return out[::-1]


def log_partition(scored: dict[tuple[int, int], list[float]], n: int) -> tuple[float, dict[tuple[int, int], np.ndarray]]:
    """Log-partition of a lattice of n tokens and the marginal of each segment and kind."""
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for i, j in scored:
        by_end.setdefault(j, []).append(i)
        by_start.setdefault(i, []).append(j)
    ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        terms = [ahead[j - 1]] + [ahead[i] + s for i in by_end.get(j, ()) for s in scored[i, j]]
        ahead[j] = np.logaddexp.reduce(terms)
    for i in range(n - 1, -1, -1):
        terms = [behind[i + 1]] + [behind[j] + s for j in by_start.get(i, ()) for s in scored[i, j]]
        behind[i] = np.logaddexp.reduce(terms)
    z = ahead[n]
    return z, {(i, j): np.exp(ahead[i] + np.array(s) + behind[j] - z) for (i, j), s in scored.items()}


# ---------------------------------------------------------------- its training


def _examples(seed: int, count: int) -> Iterator[tuple[str, list[Span]]]:
    """Made-up sentences with disguised personal data, and look-alikes without."""
    rng = np.random.default_rng(seed)

    def pick(*options: str) -> str:
        return options[int(rng.integers(len(options)))]

    def word() -> str:
        return "".join(pick("an", "er", "th", "on", "le", "mi", "so", "ka", "du", "ó", "ü", "é") for _ in range(int(rng.integers(1, 4))))

    def digits(n: int) -> str:
        return "".join(str(int(d)) for d in rng.integers(0, 10, n))

    def email() -> str:
        name = word() + pick("", ".", "_", "-") + pick("", digits(2)) if rng.random() < 0.5 else word()
        name = re.sub(r"[^a-z0-9]+$", "", re.sub("[óüé]", "e", name)) or "kim"
        host, top = pick("mail", "example", "corp", "uni") + digits(int(rng.integers(0, 2))), pick("com", "org", "net", "de", "fr")
        at = pick("(at)", "[at]", " at ", " (at) ", " [at] ", " @ ", "@ ", " @")
        dot = pick("(dot)", "[dot]", " dot ", " (dot) ", " [dot] ", ".", " . ")
        return name + at + host + dot + top

    def ip() -> str:
        parts = [str(int(x)) for x in rng.integers(0, 256, 4)]
        return pick("[.]", "(.)", " . ").join(parts)

    def card() -> str:
        body = digits(15)
        body += next(c for c in "0123456789" if luhn(body + c))
        if rng.random() < 0.3:
            return body
        return pick(".", "  ", "/", "_").join(body[k : k + 4] for k in range(0, 16, 4)).replace("  ", ".")

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        if rng.random() < 0.3:
            # run on into other digits, so that no pattern takes it
            return f"+1 ({a}) {b}-{c}"
        return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits(1)} {a} {b} {c}", f"1-{a}-{b}-{c}", f"({a}){b}-{c}")

    def decoy() -> str:
        d = digits
        bad = d(16)
        while luhn(bad):
            bad = d(16)
        return pick(
            bad, bad[:4] + "." + bad[4:8] + "." + bad[8:12] + "." + bad[12:], f"{d(2)}.{d(2)}.20{d(2)}", f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}:{d(2)}",
            f"{d(3)}.{d(3)}", f"$ {d(3)},{d(3)}", f"v{d(1)}.{d(2)}.{d(1)}", f"{d(2)} at {d(2)}", f"look at {word()} dot", f"{word()} at {word()}. {word()}",
            f"{d(4)}-{d(4)}", f"{d(12)}", f"{d(20)}", f"400.{d(3)}.900.{d(3)}", f"@{word()}", f"{word()} @ {d(2)}", f"{d(5)} {d(5)}", f"{d(2)} {d(2)} {d(2)} {d(2)}",
        )

    makers = (email, ip, card, phone)
    for _ in range(count):
        text, spans = "", []
        for _ in range(int(rng.integers(1, 4))):
            text += "".join(word() + pick(" ", " ", ", ", ". ") for _ in range(int(rng.integers(1, 6))))
            r = rng.random()
            if r < 0.5:
                kind = int(rng.integers(4))
                if rng.random() < 0.25:
                    text += pick("phone", "email", "card", "ip", "contact", "tel") + pick(" ", ": ")
                said = makers[kind]()
                spans.append((kind, len(text), len(text) + len(said)))
                text += said
                if said[0] == "+" or (kind == 2 and said.isdecimal()):
                    text += " " + pick(ip(), digits(16), digits(12))
            elif r < 0.9:
                text += decoy()
            text += pick(" ", ". ", ", ", "\n")
        yield text, spans


@lru_cache(maxsize=4)
def train(seed: int = 7, count: int = 1500, epochs: int = 4, rate: float = 0.25, decay: float = 1e-4) -> Model:
    """Fits the weights by stochastic gradient on the conditional likelihood of
    ``count`` made-up sentences; the same seed gives the same model."""
    weights: list[dict[str, float]] = [{"bias": -1.0} for _ in KINDS]
    model = Model(weights)
    cases = []
    for text, spans in _examples(seed, count):
        taken = base_spans(text)
        for lo, hi in lattice_windows(text, taken):
            tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, lo, hi)]
            found = _candidates(text, tokens, taken)
            gold = {}
            for kind, a, b in spans:
                for (i, j) in found:
                    if tokens[i][0] == a and tokens[j - 1][1] == b:
                        gold[i, j] = kind
            if found:
                cases.append((found, gold, len(tokens)))
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for c in rng.permutation(len(cases)).tolist():
            found, gold, n = cases[c]
            _, marginal = log_partition({k: model.scores(f) for k, f in found.items()}, n)
            for at, features in found.items():
                for kind in range(len(KINDS)):
                    push = step * ((gold.get(at) == kind) - float(marginal[at][kind]))
                    if abs(push) > 1e-6:
                        w = weights[kind]
                        for f in (*features, "bias"):
                            w[f] = w.get(f, 0.0) * (1 - step * decay) + push
    return Model([{f: v for f, v in w.items() if abs(v) >= 0.02 or f == "bias"} for w in weights])


def find_spans(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans; both by kind, then start."""
    base = base_spans(text)
    more: list[Span] = []
    for lo, hi in lattice_windows(text, base):
        more += decode(text, lo, hi, base, model)
    return base, sorted(base + more)


def spell(spans: Sequence[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


FIELDS = "n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string"


def _found(column: pa.Array, model: Model) -> list:
    counts: list[list[int]] = [[] for _ in KINDS]
    base_said, all_said = [], []
    for value in column:
        base, spans = find_spans(value.as_py() or "", model)
        for kind, to in enumerate(counts):
            to.append(sum(s[0] == kind for s in base))
        base_said.append(spell(base))
        all_said.append(spell(spans))
    return [*counts, base_said, all_said]


def find_personal_data(docs: DataFrame, keep: list[str] | None = None, model: Model | None = None) -> DataFrame:
    """``docs`` (columns ``keep``) with counts of base spans, and spans as text.

    Spans read ``kind:start:end``, by kind and start, joined by commas; code
    points, end exclusive.  ``base_spans`` are the patterns' own, ``spans`` have
    the model's too.  Null texts count as empty and have none; repeated rows
    are treated alike; an empty table gives no rows; clashing new columns get
    leading underscores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train())  # a few hundred weights
    return annotate.add_columns(docs, "text", lambda c: _found(c, shared.value), FIELDS, keep)


def redact(text: str, model: Model) -> str:
    """The text with each span replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(find_spans(text, model)[1], key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind]}>"]
            at = b
        else:
            at = max(at, b)
    return "".join(out) + text[at:]
