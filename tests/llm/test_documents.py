"""Operators on documents against brute force, with nulls, blanks, ties, repeated
rows, long texts, empty tables and clashing columns."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from datascry.llm import decontaminate, jaccard_join, langid, line_dedup, mixing, pii, quality, substring_dedup
from datascry.llm import words as w
from tests.llm.conftest import prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall(text or "")


def bag(rows):
    return Counter(tuple(r) for r in rows)


# ------------------------------------------------------------ op1


def test_pii_base_spans():
    text = "a.b@c.de, 1.2.3.4 999.1.1.1 é 4111 1111 1111 1111 +1 (017) 555-7713"
    spans = pii.base_spans(text)
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in spans] == [
        ("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (017) 555-7713"),
    ]
    assert pii.base_spans("4111 1111 1111 1112 +12 300.1.1") == []


def test_pii_base_against_the_plain_patterns():
    """Random strings over what the patterns look at, by Python's own scan of each."""
    import random

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def digits(s):
        return re.sub("[^0-9]", "", s)

    def plain(text):
        out = [(0, *m.span()) for m in email.finditer(text)]
        out += [(1, *m.span()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
        out += [(2, *m.span()) for m in card.finditer(text) if 16 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
        return out + [(3, *m.span()) for m in phone.finditer(text) if 8 <= len(digits(m.group())) <= 15]

    rng = random.Random(9)
    parts = ["a", "b.c", "@", ".", "1", "25", "0", "255", "4111 1111 1111 1111", "+", "-", " ", "(", ")", "_", "%", "é", "漢", "\n", "+1 (017) 555-7713", "x@y.zz", "1.2.3.4", "9.9.300.1"]
    found = Counter()
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        got = pii.base_spans(text)
        assert got == plain(text), text
        found.update(k for k, *_ in got)
    assert min(found[k] for k in range(4)) > 20


@pytest.mark.parametrize("text", ["1" * 400_000 + ".1.2", "a" * 400_000 + "@", "@" * 200_000, "9." * 200_000, "12 34 " * 3_000, "a@b.c " * 30_000, "+1" * 100_000])
def test_pii_runs_in_linear_time(text):
    import time

    began = time.process_time()
    base, spans = pii.find_spans(text, pii.train())
    assert set(base) <= set(spans)
    assert time.process_time() - began < 20


def test_pii_parts_of_any_length():
    long = "9" * 5000 + ".1.2.3"
    assert not [s for s in pii.base_spans(long) if s[0] == 1]
    padded = "0" * 5000 + "255.1.2.3"
    assert (1, 0, len(padded)) in pii.base_spans(padded)
    assert [x for x in range(2000) if pii.octet(f"00{x}")] == list(range(256)) and pii.octet("000")


def test_pii_model_adds_and_keeps(spark, docs, empty):
    model = pii.train()
    found = total = extra = 0
    for text, spans in pii._examples(123, 400):
        base, got = pii.find_spans(text, model)
        assert set(base) <= set(got)
        added = set(got) - set(base)
        assert not any(a < y and x < b for _, a, b in added for _, x, y in base)
        want = {s for s in spans if not any(b[1] < s[2] and s[1] < b[2] for b in base)}
        found, total, extra = found + len(added & want), total + len(want), extra + len(added - want)
    assert found / total > 0.9
    assert extra / total < 0.15
    text = "write to jo.doe (at) example (dot) com now"
    assert [text[a:b] for _, a, b in pii.find_spans(text, model)[1]] == ["jo.doe (at) example (dot) com"]
    out = pii.find_personal_data(docs.withColumn("spans", F.lit("x")), model=model)
    assert out.columns[-6:] == ["n_email", "n_ip", "n_card", "n_phone", "base_spans", "_spans"]
    assert out.count() == docs.count()
    assert pii.find_personal_data(empty, model=model).count() == 0
    assert pii.redact("mail a@b.cc now", model) == "mail <email> now"


def test_pii_lattice_partition():
    z, marginal = pii.log_partition({(0, 1): [0.0], (0, 2): [0.0], (1, 2): [0.0]}, 2)
    # O O, E O, O E, E E, and one long segment
    assert z == pytest.approx(1.6094379124341003)
    assert float(marginal[0, 2][0]) == pytest.approx(0.2)


# ------------------------------------------------------------ op3


def expected_removal(rows, window):
    said = [words(r.text) for r in rows]
    count = Counter(tuple(x[i : i + window]) for x in said for i in range(len(x) - window + 1))
    out = []
    for r, x in zip(rows, said, strict=True):
        gone = set()
        for i in range(len(x) - window + 1):
            if count[tuple(x[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((r.doc_id, len(x), len(gone), " ".join(v for i, v in enumerate(x) if i not in gone)))
    return Counter(out)


@pytest.mark.parametrize(("window", "k"), [(35, 10), (6, 3)])
def test_substring_dedup(docs, window, k):
    got = substring_dedup.remove_repeats(docs, ["doc_id"], window, k).collect()
    assert bag(got) == expected_removal(docs.collect(), window)


def test_substring_dedup_edges(spark, docs, empty):
    assert substring_dedup.remove_repeats(empty).count() == 0
    out = substring_dedup.remove_repeats(docs.limit(3).withColumn("n_words", F.lit(1)))
    assert out.columns == [*docs.columns, "n_words", "_n_words", "n_removed", "kept_text"]


# ------------------------------------------------------------ op4


def brute_measures(text):
    text = text or ""
    said = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(said[i : i + 3]) for i in range(len(said) - 2)]
    count = Counter(grams)
    twice = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 3)}
    return len(said), sum(map(len, said)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(twice)


def test_quality_measures_and_verdict(docs, empty):
    rated = quality.rate(docs.withColumn("kept", F.lit(7)), sample_rows=8)
    assert rated.columns[-1] == "_kept"
    for r in rated.collect():
        want = brute_measures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["_kept"] and r.base_failed)
    assert quality.rate(empty).count() == 0
    assert quality.filter_quality(empty).count() == 0
    kept = {r.doc_id for r in quality.filter_quality(docs).collect()}
    assert {0, 3, 4, 5} <= kept
    assert not {12, 13, 14, 15, 18} & kept


def test_quality_order_changes_no_verdict(docs):
    texts = [r.text for r in docs.collect()]
    ordered, report = quality.order_rules(texts)
    assert {r.name for r in ordered} == {r.name for r in quality.RULES}
    ranks = [x["rejects"] / max(x["cost"], 1e-9) for x in report]
    assert ranks == sorted(ranks, reverse=True)
    import pyarrow as pa

    column = pa.array(texts, pa.string())
    a, b = (quality._rated(column, rules, True)[0].tolist() for rules in (ordered, tuple(reversed(ordered))))
    assert a == b


def brute_verdict(text, flagged):
    """The names of all rules that reject a text, one by one."""
    said = words(text)
    n, chars, symbols, dup, repeated = brute_measures(text)
    text = text or ""
    upper, lower = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    lines = sum(bool(WORDS.search(x)) for x in text.split("\n"))
    bad = {
        "few_words": n < 50, "word_length": chars < 2 * n or chars > 20 * n, "symbols": 10 * symbols > n, "capitals": upper > lower and upper > 20,
        "duplicate_lines": 10 * dup > 6 * lines, "repeated_windows": 100 * repeated > 50 * n,
        "flagged_words": bool(set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))) & set(flagged)),
    }
    return {k for k, v in bad.items() if v}


def quality_texts():
    good = prose(31, 80)
    return [
        None, "", good, good + " You IDIOT! " + good, good.upper(), good + " #" * 40, "\n".join([good.split("\n")[0]] * 12), "a b " * 60, good + "x" * 9000,
        "x " * 70, prose(32, 49), prose(33, 50), good + " Grobz, é", "é " * 60, "\n\n" + good, good + "\n" * 50, prose(7, 20_000),
    ]


def test_quality_verdict_against_all_rules(spark):
    texts = quality_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    rules = quality.with_flagged(["grobz"])
    flagged = [*quality.FLAGGED, "grobz"]
    rejected = {i: brute_verdict(t, flagged) for i, t in enumerate(texts)}
    assert set().union(*rejected.values()) == {r.name for r in rules}
    kept = {i for i, bad in rejected.items() if not bad}
    assert kept and {r.doc_id for r in quality.filter_quality(df, rules).collect()} == kept
    assert {r.doc_id for r in quality.rate(df, rules=rules).collect() if r.kept} == kept


def test_cascade_computes_for_survivors_alone():
    import pyarrow as pa

    texts = quality_texts()
    seen = []

    def watched(rule):
        def rejects(m):
            seen.append((rule.name, len(m)))
            return rule.rejects(m)

        return quality.Rule(rule.name, rejects)

    for rules in (quality.RULES, tuple(reversed(quality.RULES))):
        seen.clear()
        quality._rated(pa.array(texts), tuple(map(watched, rules)), True)
        alive, want = list(texts), []
        for r in rules:
            want.append((r.name, len(alive)))
            alive = [t for t in alive if r.name not in brute_verdict(t, quality.FLAGGED)]
        # one chunk holds them all
        assert seen == want
        assert len(alive) < len(texts) - 5


def test_flagged_words_are_learned(spark):
    rows = [(i, f"plain words here {'grobz' if i % 4 == 0 else 'fine'}", int(i % 4 == 0)) for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    assert quality.learn_flagged(docs, labels) == ["grobz"]
    assert quality.learn_flagged(docs, labels.limit(0)) == []


# ------------------------------------------------------------ op5


def test_langid(spark, docs, empty):
    rows = [("en", "the house and the garden of the king " * 3), ("fr", "la maison et le jardin du roi est belle " * 3), ("de", "das haus und der garten des königs ist schön " * 3)]
    filters = langid.learn(spark.createDataFrame(rows + [(None, "x"), ("en", None)], "lang string, text string"))
    assert filters.langs == ["de", "en", "fr"]
    ask = [("the garden and the house", "en"), ("le jardin et la maison", "fr"), ("der garten und das haus", "de"), (None, "und"), ("", "und"), ("123 !?", "und"), ("漢字", "de"), ("²", "und"), ("😀😀", "und"), ("。。。", "und"), ("— — —", "und"), ("€€€ 12", "und"), ("😀é", "de")]
    got = langid.predict(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ask)], "doc_id long, text string"), filters).collect()
    for r in got:
        assert r.lang_pred == ask[r.doc_id][1]
        assert 0 <= r.score <= 1
    nothing = langid.learn(spark.createDataFrame([], "lang string, text string"))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(empty, filters).count() == 0


def test_langid_against_plain_sets(spark):
    """Wide filters have no false positives here, so shares are those of plain sets of grams."""
    rng = __import__("random").Random(8)
    speech = {"en": "the house and garden of king", "fr": "la maison et le jardin du roi é", "de": "das haus und der garten größe"}
    train = [(lang, " ".join(rng.choice(x.split()) for _ in range(60))) for lang, x in speech.items() for _ in range(5)]
    filters = langid.learn(spark.createDataFrame(train, "lang string, text string"), bits=22)

    def grams_of(text):
        data = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in text.lower().encode())
        return [data[i : i + 4] for i in range(len(data) - 3) if data[i + 1] != 0x20 and data[i + 2] != 0x20]

    held = {lang: {g for x, t in train if x == lang for g in grams_of(t)} for lang in speech}
    texts = ["".join(rng.choice([*" ".join(speech.values()), "Q", "!", "漢"]) for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    texts += [" ".join(rng.choice(" ".join(speech.values()).split()) for _ in range(9)) for _ in range(60)]
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), filters).collect()
    for r in got:
        mine = grams_of(r.text)
        if not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        share = {lang: sum(g in held[lang] for g in mine) / max(len(mine), 1) for lang in sorted(held)}
        assert r.score == pytest.approx(max(share.values()), abs=1e-3)
        assert share[r.lang_pred] == pytest.approx(max(share.values()), abs=1e-3)


def test_langid_has_no_false_negatives():
    import numpy as np

    grams = {lang: np.arange(i * 500, i * 500 + 800, dtype=np.int64) for i, lang in enumerate(["a", "b", "c"])}
    filters = langid.Filters.build(grams, bits=14)
    for i, lang in enumerate(filters.langs):
        mask = filters.languages(grams[lang])[0]
        assert ((mask >> np.uint64(i)) & np.uint64(1)).all()


def test_held_out_is_crc32(spark):
    import zlib

    got = spark.range(50).select("id", langid.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


# ------------------------------------------------------------ op6


def test_line_dedup(docs, empty):
    import pyarrow as pa

    cutter = line_dedup.Chunker()
    rows = docs.collect()
    got = bag((r.doc_id, r.text, r.n_lines, r.n_lines_removed) for r in line_dedup.remove_repeated_chunks(docs).collect())

    def chunks(text):
        for _, data, starts, ends, lo, hi, _, number, _ in cutter.chunks(pa.array([text], pa.string())):
            for i in range(len(lo)):
                yield int(number[i]), data[starts[lo[i]] : ends[hi[i] - 1]].tobytes(), int(hi[i] - lo[i])

    from datascry.llm.common import text_key

    keys = {(r.doc_id, r.text): r.k for r in docs.select("doc_id", "text", text_key(F.col("text")).alias("k")).collect()}
    order = lambda r: (r.doc_id is None, r.doc_id or 0, keys[r.doc_id, r.text])
    first = {}
    for r in sorted(rows, key=order):
        for number, said, n in chunks(r.text):
            if n >= 2:
                first.setdefault(said, (r.doc_id, keys[r.doc_id, r.text], number))
    want = Counter()
    for r in rows:
        parts, n_lines, gone = [], 0, 0
        for number, said, n in chunks(r.text):
            n_lines += n
            if n >= 2 and first[said] != (r.doc_id, keys[r.doc_id, r.text], number):
                gone += n
            else:
                parts.append(said.decode())
        want[r.doc_id, "\n".join(parts) if gone else r.text, n_lines, gone] += 1
    assert got == want
    assert sum(k[3] for k in want) > 0
    assert line_dedup.remove_repeated_chunks(empty).count() == 0
    assert line_dedup.remove_repeated_chunks(docs.withColumn("N_LINES", F.lit(1))).columns[-2:] == ["_n_lines", "n_lines_removed"]


def test_chunks_end_where_the_rolling_hash_says():
    """Boundaries from one line's hashes at a time, without the vectorised chunker."""
    import numpy as np
    import pyarrow as pa

    def line_code(line):
        data = np.frombuffer(line, dtype=np.uint8)
        return w.byte_spans(data, np.array([0]), np.array([len(line)]))

    rng = __import__("random").Random(4)
    texts = ["\n".join(rng.choice(["", "a", "bb b", "é", "x" * 90]) + str(rng.randrange(9)) * rng.randrange(2) for _ in range(rng.randrange(90))) for _ in range(20)]
    for span, mean, most in ((2, 3, 64), (1, 4, 5)):
        cutter = line_dedup.Chunker(span, mean, most)
        for text in [*texts, "", None, "\n", "one"]:
            got = [(int(lo[i]), int(hi[i])) for *_, lo, hi, _, _, _ in cutter.chunks(pa.array([text], pa.string())) for i in range(len(lo))]
            lines = text.encode().split(b"\n") if text else []
            want, begin = [], 0
            for i in range(len(lines)):
                codes = np.concatenate([line_code(x) for x in lines[max(0, i - span + 1) : i + 1]])
                rolling = int(w.word_spans(codes, np.array([0]), np.array([len(codes)]))[0])
                if rolling % mean == 0 or i == len(lines) - 1 or i - begin + 1 == most:
                    want.append((begin, i + 1))
                    begin = i + 1
            assert got == want


def test_chunk_boundaries_shift_with_the_text():
    import pyarrow as pa

    cutter = line_dedup.Chunker()
    lines = [f"line number {i * i}" for i in range(200)]

    def said(rows):
        text = "\n".join(rows)
        return {data[s[lo[i]] : e[hi[i] - 1]].tobytes() for _, data, s, e, lo, hi, *_ in cutter.chunks(pa.array([text])) for i in range(len(lo))}

    a, b = said(lines), said(["new first line", *lines])
    assert len(a & b) >= len(a) - 2


def brute_line_runs(rows, keys, least=2):
    """Lines of all runs that begin before, by the bytes of every pair of places."""
    order = lambda r: (r.doc_id is None, r.doc_id or 0, keys[r.doc_id, r.text])
    first = {}
    for r in sorted(rows, key=order):
        lines = r.text.split("\n") if r.text else []
        for i in range(len(lines) - least + 1):
            first.setdefault(tuple(lines[i : i + least]), (order(r), i))
    want = Counter()
    for r in rows:
        lines = r.text.split("\n") if r.text else []
        drop = set()
        for i in range(len(lines) - least + 1):
            if first[tuple(lines[i : i + least])] != (order(r), i):
                drop.update(range(i, i + least))
        left = "\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else r.text
        want[r.doc_id, left, len(lines), len(drop)] += 1
    return want


def test_repeated_line_runs(spark, docs, empty):
    from datascry.llm.common import text_key
    from tests.llm.conftest import SCHEMA, prose

    # one passage of 2, 3 and 12 lines in documents that are otherwise foreign, at the start, within and at the end
    more = []
    for i in range(30):
        passage = prose(500 + i % 3, (24, 36, 144)[i % 3])
        parts = [prose(1000 + i, 60), passage, prose(2000 + i, 60)]
        more.append((100 + i, "\n".join(parts[i % 2 : 3 - (i // 2) % 2]), "en", "s", 1))
    more += [(200, "x\nx\nx\nx", "en", "s", 7), (201, "\n\n\n", "en", "s", 3), (202, "x\ny\n", "en", "s", 4), (203, "é\n漢\ny\né\n漢", "en", "s", 9)]
    all_docs = docs.unionByName(spark.createDataFrame(more, SCHEMA)).repartition(5)
    rows = all_docs.collect()
    keys = {(r.doc_id, r.text): r.k for r in all_docs.select("doc_id", "text", text_key(F.col("text")).alias("k")).collect()}
    cleaned = line_dedup.remove_repeated_lines(all_docs)
    got = cleaned.collect()
    assert bag((r.doc_id, r.text, r.n_lines, r.n_lines_removed) for r in got) == brute_line_runs(rows, keys)
    # each later copy of a passage is gone whole
    for i in range(3, 30):
        left = next(r.text for r in got if r.doc_id == 100 + i)
        assert not set(prose(500 + i % 3, (24, 36, 144)[i % 3]).split("\n")) & set(left.split("\n"))
    # no line is lost from all documents
    assert {x for r in rows for x in (r.text or "").split("\n")} - {""} == {x for r in got for x in (r.text or "").split("\n")} - {""}
    assert line_dedup.remove_repeated_lines(empty).count() == 0


def test_line_dedup_query_removes_whole_passages(spark, tmp_path):
    from datascry.llm.queries import QUERIES
    from tests.llm.conftest import SCHEMA, prose

    passage = prose(77, 96)  # 8 lines
    texts = ["\n".join([prose(300 + i, 48), passage, prose(400 + i, 48)]) for i in range(12)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_lines_removed) for r in QUERIES["op6_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {i: (16, 8 if i else 0) for i in range(12)}


# ------------------------------------------------------------ op8


def brute_components(rows, percent=80):
    sets = []
    for r in rows:
        x = words((r.text or "").translate(LOWER))
        sets.append(frozenset(tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))) if x else frozenset())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    names = defaultdict(list)
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            names[find(i)].append(r.doc_id)
    return Counter(
        (r.doc_id, len(sets[i]), (min(names[find(i)]) if names[find(i)] else None) if sets[i] else r.doc_id) for i, r in enumerate(rows)
    )


def test_jaccard_join(docs, empty):
    assert bag(jaccard_join.near_duplicates(docs).collect()) == brute_components(docs.collect())
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_jaccard_join_on_planted_near_copies(spark):
    import random

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        n = rng.choice([3, 5, 6, 9, 14, 30, 60, 150, 400])
        base = [rng.choice(vocabulary) for _ in range(n)]
        for _ in range(6):
            x = list(base)
            for _ in range(rng.randint(0, max(1, n // 30))):
                x[rng.randrange(len(x))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                x = x[: max(1, len(x) - rng.randint(0, n // 10))]
            rows.append((len(rows), " ".join(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(jaccard_join.near_duplicates(df).collect()) == brute_components(df.collect())


def test_jaccard_join_within_large_groups(spark, monkeypatch):
    """A family whose members share many signatures but fall into several components,
    with signatures dealt as heavy ones and few centres in each round."""
    import random

    monkeypatch.setattr(jaccard_join, "SAMPLE", 10)
    monkeypatch.setattr(jaccard_join, "CENTRES", (1, 2))
    rng = random.Random(11)
    base = [f"v{i}" for i in range(260)]
    rows = []
    for i in range(60):
        x = list(base)
        for _ in range(rng.randint(0, 16)):
            x[rng.randrange(len(x))] = f"n{rng.randrange(10**6)}"
        rows += [(100 - i, " ".join(x))] * rng.choice([1, 1, 2])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(df.collect())
    assert 3 < len({k[2] for k in want}) < 60
    assert bag(jaccard_join.near_duplicates(df).collect()) == want


def thue_morse(n):
    """Letters that collide with their complement under polynomials modulo 2**64 in any odd base."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096])
def test_unequal_words_with_equal_power_sums(spark, n):
    import numpy as np
    import pyarrow as pa

    one, two = thue_morse(n)
    shared = words(prose(3, 60))
    texts = [" ".join([*shared[:20], x, *shared[20:]]) for x in (one, two)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, one, two, f"{one} b\n{two} b\n{one} b"])], "doc_id long, text string")
    rows = df.collect()
    got = substring_dedup.remove_repeats(df, ["doc_id"]).collect()
    assert bag(got) == expected_removal(rows, 35)
    assert bag(jaccard_join.near_duplicates(df).collect()) == brute_components(rows)
    assert {r.doc_id: r.n_dup_lines for r in quality.rate(df).collect()} == {r.doc_id: brute_measures(r.text)[3] for r in rows}
    items = [(1, " ".join([*shared[5:20], one, shared[20]]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, -1):
        hits = decontaminate.mark_contaminated(df, bench, ["doc_id"], max_broadcast_bytes=limit).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in hits) == brute_hits(rows, items)
    # the same among the codes of words
    codes = np.array([5, 9], dtype=np.uint64)[[bin(i).count("1") % 2 for i in range(n)]]
    a, b = (w.word_spans(c, np.array([0]), np.array([n])) for c in (codes, np.uint64(14) - codes))
    assert a[0] != b[0]
    for _, part in decontaminate._texts(pa.array([f"{one} {two}"])):
        assert len(set(part.hashes().tolist())) == 2


def test_span_hash_is_a_polynomial_modulo_a_prime():
    import numpy as np

    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**64 - 1, 300, dtype=np.uint64)
    starts, ends = np.array([0, 5, 17, 100, 300]), np.array([0, 30, 300, 101, 300])
    want = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        total = sum(int(c) * pow(w._BASE, i, w.PRIME) for i, c in enumerate(codes[a:b].tolist())) % w.PRIME
        want.append((total + ((b - a) << 61)) % 2**64)
    assert w.word_spans(codes, starts, ends).tolist() == w._mixed(np.array(want, dtype=np.uint64)).tolist()


def test_partition_scheme_misses_no_pair():
    import numpy as np

    scheme, rng = jaccard_join.Scheme(), np.random.default_rng(3)
    top = 2**64 - 1
    for n in [1, 2, 3, 4, 5, 7, 8, 11, 14, 21, 22, 34, 35, 55, 56, 120, 400, 1500]:
        sets = []
        for _ in range(40):
            a = np.unique(rng.integers(0, top, n, dtype=np.uint64))
            gone = int(rng.integers(0, n // 5 + 1))
            new = 0
            while (n - gone) * 100 >= 80 * (n + new + 1):
                new += 1
            b = np.unique(np.concatenate([rng.permutation(a)[: n - gone], rng.integers(0, top, new, dtype=np.uint64)]))
            sets += [a, b]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        held = [set() for _ in sets]
        for who, sigs in scheme.signatures(np.concatenate(sets), bounds):
            for i, s in zip(who.tolist(), sigs.tolist(), strict=True):
                held[i].add(s)
        for i in range(0, len(sets), 2):
            both = len(np.intersect1d(sets[i], sets[i + 1]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[i + 1]) - both):
                assert held[i] & held[i + 1], (n, i)


def test_keep_one_each(docs, empty):
    kept = jaccard_join.keep_one_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[0] == 1 and not ids[6] and not ids[7] and not ids[8]
    assert ids[12] == ids[13] == ids[14] == 1 and ids[None] == 1
    assert jaccard_join.keep_one_each(empty).count() == 0


# ------------------------------------------------------------ op9

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(rows, items, window=10):
    wins = []
    for item, text in items:
        x = ALNUM.findall((text or "").translate(LOWER))
        n = min(window, len(x))
        wins += [(item, tuple(x[i : i + n])) for i in range(len(x) - n + 1)] if n else []
    out = Counter()
    for r in rows:
        x = ALNUM.findall((r.text or "").translate(LOWER))
        hit, seen = set(), set()
        at = defaultdict(list)
        for n in {len(v) for _, v in wins}:
            for i in range(len(x) - n + 1):
                at[tuple(x[i : i + n])].append(i)
        for item, v in wins:
            for i in at.get(v, ()):
                hit.update(range(i, i + len(v)))
                seen.add(str(item) if item is not None else "")
        out[r.doc_id, len(x), len(hit), tuple(sorted(seen)), bool(hit)] += 1
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontaminate(spark, docs, empty, broadcast):
    from tests.llm.conftest import prose

    base = prose(0, 90).split()
    items = [
        (1, " ".join(base[10:40])), (2, " ".join(base[5:14])), (3, "two words"), (4, None), (5, "..."), (6, "Is, ONHE is; onhe is onhe is onhe is onhe is"),
        (7, prose(400, 50)), (8, " ".join(base[60:75]) + " never seen " + " ".join(base[75:90])), (1, " ".join(base[10:40])), (None, "one"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    limit = {"max_broadcast_bytes": 1 << 20 if broadcast else -1}
    got = decontaminate.mark_contaminated(docs, bench, ["doc_id"], **limit).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in got) == brute_hits(docs.collect(), items)
    assert decontaminate.mark_contaminated(empty, bench, **limit).count() == 0
    assert decontaminate.mark_contaminated(docs, bench.limit(0), **limit).filter("contaminated").count() == 0
    clash = decontaminate.mark_contaminated(docs.withColumn("n_hit", F.lit("x")), bench, **limit)
    assert clash.columns[-4:] == ["n_words", "_n_hit", "item_ids", "contaminated"]


def test_a_passage_that_many_items_share_is_looked_up_once(spark):
    import pyarrow as pa

    from tests.llm.conftest import prose

    common = " ".join(prose(3, 40).split()[:13])
    items = [(i, f"{prose(100 + i, 12)} {common} {prose(5000 + i, 12)}") for i in range(300)] + [(i, "as short as this") for i in range(300, 340)]
    index = decontaminate.Index([str(i) for i, _ in items], pa.array([t for _, t in items]))
    text = f"{prose(9, 30)} {common} {prose(10, 30)} {common} as short as this"
    ((_, part),) = decontaminate._texts(pa.array([text]))
    hits = {size: len(at) for size, at, _ in index.find(part)}
    assert hits[10] <= 4 * 2 + 20  # windows, whatever the number of items
    assert hits[4] == 1
    rows = spark.createDataFrame([(1, text), (2, prose(11, 60)), (3, items[7][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, -1):
        got = decontaminate.mark_contaminated(rows, bench, ["doc_id"], max_broadcast_bytes=limit).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in got) == brute_hits(rows.collect(), items)


# ------------------------------------------------------------ op10


def brute_budgets(leaves, total, most, weights):
    """Leaf budgets by bisection of the common level, top down."""

    def share(budget, children):
        caps = {c: most * sum(t for p, t in leaves.items() if p[: len(c)] == c) for c in children}
        whole = min(budget, sum(caps[c] for c in children if weights.get(c, 1) > 0))
        lo, hi = 0.0, 1e15
        for _ in range(300):
            mid = (lo + hi) / 2
            if sum(min(caps[c], mid * weights.get(c, 1)) for c in children) < whole:
                lo = mid
            else:
                hi = mid
        return {c: min(caps[c], hi * weights.get(c, 1)) for c in children}

    level = {(): total}
    for depth in (1, 2, 3):
        below = {}
        for node, budget in level.items():
            children = sorted({p[:depth] for p in leaves if p[: depth - 1] == node})
            below |= share(budget, children)
        level = below
    return level


def test_mixing_budgets(spark):
    tokens = {("a", "en", "s1"): 1000, ("a", "en", "s2"): 10, ("a", "fr", "s1"): 50, ("b", "en", "s1"): 400, ("b", "de", "s9"): 7, ("c", "en", "s1"): 0}
    leaves = spark.createDataFrame([(*k, v, 1) for k, v in tokens.items()], "domain string, lang string, source string, tokens long, docs long")
    weights = spark.createDataFrame([("a", None, None, 3.0), ("b", "de", None, 5.0)], "domain string, lang string, source string, weight double")
    named = {("a",): 3.0, ("b", "de"): 5.0}
    for total in (0, 100, 900, 3000, 50_000):
        for given, table in (({}, None), (named, weights)):
            got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(leaves, total, table).collect()}
            want = brute_budgets(tokens, total, 4, given)
            assert all(abs(got[k] - want[k]) <= 1 for k in tokens), (total, got, want)


def test_mix_sources(spark, docs, empty):
    for ratio in (0.3, 1.0, 2.5):
        out = mixing.mix_sources(docs, budget_ratio=ratio, bucket_docs=2).collect()
        rows = docs.select("*", mixing.domain_of(F.col("source")).alias("d"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("again")).collect()
        leaves = defaultdict(int)
        for r in rows:
            leaves[str(r.d), str(r.lang), str(r.source)] += len(words(r.text))
        budget = brute_budgets(dict(leaves), ratio * sum(leaves.values()), 4, {})
        taken = defaultdict(int)
        copies = Counter()
        for r in out:
            taken[str(r.mix_domain), str(r.lang), str(r.source)] += r.mix_tokens
            copies[r.doc_id, r.text] += 1
        for leaf, tokens in leaves.items():
            longest = max(len(words(r.text)) for r in rows if (str(r.d), str(r.lang), str(r.source)) == leaf)
            assert taken[leaf] <= budget[leaf] + 1
            # repeated rows are taken together
            assert taken[leaf] > budget[leaf] - 2 * longest - 2 or not tokens, leaf
            mine = [r for r in rows if (str(r.d), str(r.lang), str(r.source)) == leaf]
            whole = min(4, int((budget[leaf] + 1e-6) // tokens)) if tokens else 0
            assert all(whole <= copies[r.doc_id, r.text] / sum((x.doc_id, x.text) == (r.doc_id, r.text) for x in rows) <= whole + 1 for r in mine)
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mix_sources(docs.withColumn("mix_epoch", F.lit("x"))).columns[-3:] == ["mix_domain", "mix_tokens", "_mix_epoch"]


def test_mixing_is_the_seeded_prefix(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", "s") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix_sources(df, budget_ratio=0.4, bucket_docs=16, seed=3).collect()
    total = int(sum(i % 7 + 1 for i in range(300)) * 0.4 + 1e-6)

    def place(r):
        again = hashlib.md5(r[1].encode()).hexdigest()
        return int(hashlib.md5(f"3:0:{r[0]}:{again}".encode()).hexdigest()[:12], 16), str(r[0]), again

    left, want = total, set()
    for r in sorted(rows, key=place):
        left -= r[0] % 7 + 1
        if left < 0:
            break
        want.add(r[0])
    assert {r.doc_id for r in out} == want


# ------------------------------------------------------------ words


def test_words_and_hashes_agree_with_plain_python():
    import numpy as np
    import pyarrow as pa

    texts = ["a bb  a\tbb", "", None, "é\x0bü", "x" * 5000, " a bb "]
    got = {}
    for lo, _, data, offsets in w.chunks(pa.array(texts), limit=8):
        part = w.Texts(data, offsets)
        codes = part.hashes()
        for i in range(len(part)):
            a, b = part.first[i], part.first[i + 1]
            got[lo + i] = [(part.word(j).decode(), int(codes[j])) for j in range(a, b)]
    for i, t in enumerate(texts):
        assert [x for x, _ in got[i]] == words(t)
    by_word = defaultdict(set)
    for pairs in got.values():
        for word, code in pairs:
            by_word[word].add(code)
    assert all(len(c) == 1 for c in by_word.values())
    assert len({c for s in by_word.values() for c in s}) == len(by_word)
    values = np.random.default_rng(0).integers(0, 2**64 - 1, 200, dtype=np.uint64)
    for width in (1, 2, 5, 26):
        assert w.sliding_argmin(values, width).tolist() == [int(np.argmin(values[i : i + width])) + i for i in range(200 - width + 1)]
