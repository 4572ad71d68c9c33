"""Operators 11 to 13 against brute force, and round trips of the token files."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from datascry.llm import common, filter_audit, spelling, token_files

DOCS = "doc_id long, text string, lang string, part string, n long, word string"


def frame(spark, rows):
    """Documents with extra columns of clashing names."""
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], DOCS)


# ------------------------------------------------------------ filter audit


def audited(rows, labels):
    """All 600 rows for each part, document by document."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    masks = defaultdict(list)
    for doc_id, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows),
        }
        masks[lang or ""].append((doc_id, {f for f in fails if fails[f]}))
    out = {}
    for part, docs in masks.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                c, before = Counter(), set(order[: step - 1])
                for i, failed in docs:
                    here = f in failed and not failed & before
                    c["kept"] += not failed & (before | {f})
                    c["removed"] += here
                    c["redundant"] += f in failed and not here
                    c["unique_fails"] += failed == {f}
                    c["good_lost"] += here and i in good
                    c["toxic_lost"] += here and i in toxic
                shapley[f] += c["removed"]
                out[part, "".join(order), step] = c
        for (p, order, step), c in out.items():
            if p == part:
                c["shapley"] = shapley[order[step - 1]]
    return {k: tuple(c[x] for x in (*filter_audit.COUNTS, "shapley")) for k, c in out.items()}


def test_audit_against_brute_force(spark):
    rng = random.Random(3)
    said = [" ".join(f"w{rng.randrange(150)}" for _ in range(120)) for _ in range(6)] + ["SHOUT " * 110, "a b", "", None, "price $5 " * 60, " \t\n", "é\x0b" * 300]
    rows = [(i if i % 11 else None, rng.choice(said), rng.choice(["en", "fr", None, ""])) for i in range(80)]
    rows += [(12, rows[12][1], "en"), (12, rows[12][1], "fr"), (12, "other", "fr"), (900, said[0], "de"), (901, said[0], "de"), (902, "x " * 40_000, "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 80, 2)] + [(12, 0, 0), (12, 1, 1), (None, 1, 1), (900, 1, 0), (901, None, 1)]
    got = filter_audit.audit_orders(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*filter_audit.COUNTS, "shapley")) for r in got.collect()}
    want = audited(rows, labels)
    assert len(want) == 4 * 600 and found == want


def test_audit_of_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_orders(frame(spark, []), labels).count() == 0
    one = filter_audit.audit_orders(frame(spark, [(None, None, None)]), labels)
    assert one.count() == 600 and one.agg(F.sum("good_lost") + F.sum("kept")).first()[0] == 0 + sum(1 for o in permutations("ABCDE") for s in range(5) if "A" not in o[: s + 1])


# ------------------------------------------------------------ spelling


def spelled(rows, drop_every):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def edit_apart(u, v):
    if len(u) > len(v):
        u, v = v, u
    if u == v or len(v) - len(u) > 1:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def grouped(words, ratio=5):
    near = {w: [v for v in words if edit_apart(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: best[w] if w in best and words[best[w]] >= ratio * words[w] else None for w in words}
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("drop_every", [None, 3, 199])
def test_spelling_against_brute_force(spark, drop_every):
    rng = random.Random(drop_every or 1)
    stems = ["Straße", "élèves", "garçon", "banana", "bananas", "ananas", "abcdefghij", "abcdefghjj", "bcdefghij", "aaaaaa", "aaaaaaa", "aaaaaaaa", "x×y÷zabc", "INNOVATION", "ÀÉÎÕÜß"]
    rows = [(i if i % 7 else None, " ".join(rng.choice(stems) + rng.choice(["", "", ", ", "1", "œ", "中"]) for _ in range(60))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "b" * 50_000 + " " + "é" * 70), (102, "banana " * 400), (102, "banana " * 400)]
    rows += [(200 + i, ("b" * 50_000 + " " + "b" * 24_000 + "c" + "b" * 25_999 + " " + "é" * 70 + " ") * 2) for i in range(4)]
    docs = frame(spark, [(i, t, None) for i, t in rows])
    words = spelling.count_words(docs, drop_every=drop_every)
    want = spelled(rows, drop_every)
    assert {r["word"]: r["n"] for r in words.collect()} == want
    assert variants(spelling.group_variants(words)) == grouped(want)


def test_crc_of_each():
    rng = random.Random(5)
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 2, 7, 64, 65, 300, 3)]
    data, ends = np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum([len(p) for p in parts])
    begun = np.array([zlib.crc32(b"%d:" % i) for i in range(len(parts))], dtype=np.uint32)
    got = spelling.crc32_each(data, ends - [len(p) for p in parts], ends, begun)
    assert got.tolist() == [zlib.crc32(p, zlib.crc32(b"%d:" % i)) for i, p in enumerate(parts)]


def test_large_stretches_are_divided(spark):
    """Many words of one prefix, of one suffix, and of one free place: same pairs at any limit."""
    rng = random.Random(9)
    words = {"prefix" + "".join(rng.choice("abc") for _ in range(5)) for _ in range(150)} | {"".join(rng.choice("abc") for _ in range(5)) + "suffix" for _ in range(150)}
    words |= {"hotspo" + c for c in "abcdefghijklmnopqrstuvwxyz"} | {"hotspo" + c + d for c in "abcdef" for d in "abcdef"}
    want = {(u, v) for u in words for v in words if edit_apart(u, v)}
    df = spark.createDataFrame([(w, 5) for w in sorted(words)], "word string, n long")
    for most in (4, 40, 20_000):
        got = [(r["word"], r["near"]) for r in spelling.near_words(df, most_block=most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_long_chains_of_forms(spark):
    chain = ["abcdef" + "x" * i for i in range(9)]
    df = spark.createDataFrame([(w, 5 * 6**i) for i, w in enumerate(chain)], "word string, n long")
    got = variants(spelling.group_variants(df))
    assert {w: g[1] for w, g in got.items()} == dict.fromkeys(chain, chain[-1]) and got[chain[0]][0] == chain[1]


def test_spelling_of_empty_tables(spark):
    for rows in ([], [(1, None, None), (None, "", None), (2, "short 12345 中文", None)]):
        assert spelling.group_variants(spelling.count_words(frame(spark, rows))).count() == 0


# ------------------------------------------------------------ token files


PATH = public_tokenizers.path("word_bpe_49k.json")


def whole_text_ids(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def odd_texts(n=400, seed=2):
    rng = random.Random(seed)
    parts = ["The", "don't", "we'll", "IT'S", "<|endoftext|>", "<|startoftext|>x", "é", "é", "́", "ΟΔΟΣ", "Σ", "İ", "中文字", "😀👍🏽", " ", " ", "\x1c", "\x85", "​", "12345", "½", "...", "!?", "_", "naïve", "ﬁ", "가", "'s", "''t", "word.", "Élan,", "l'eau!?", "x×.", "a.b.", "".join(map(chr, range(0xC0, 0x100))), "ÀÉÎõü?", "﻿", "ａｂ"]
    return ["".join(rng.choice(parts) + rng.choice(["", "", " ", "  ", "\n", "\t\r\n", "\x0b", "\x0c"]) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


def test_ids_by_words_are_those_of_whole_texts():
    texts = odd_texts() + ["", " ", "\n\n", "a" * 5000, "word " * 3000]
    encode = token_files.Encoder(PATH, split=True)
    plain = token_files.Encoder(PATH, split=False)
    raw, want = [t.encode() for t in texts], whole_text_ids(texts)
    for few in (1, 7, len(raw)):  # words that are known already, or not
        assert [x.tolist() for i in range(0, len(raw), few) for x in encode(raw[i : i + few])] == want
    assert [x.tolist() for x in plain(raw)] == want


def test_grammar_round_trip_and_slices():
    rng = np.random.default_rng(4)
    phrase = rng.integers(0, 40_000, 12)
    docs = [np.array([1]), np.full(1001, 5), np.array([7, 1])] + [np.append(np.concatenate([phrase, rng.integers(0, 60_000, rng.integers(0, 30)), phrase[3:]]), 1) for _ in range(200)]
    docs.append(np.arange(70_000))
    docs = [d.astype(np.uint32) for d in docs]
    shard = token_files.Shard.of([None, *range(1, len(docs))], docs)
    body = bytes(shard)
    again = token_files.Shard.read(body)
    assert len(shard.rules) > 5 and len(body) < 8 * sum(map(len, docs))
    assert again.null.tolist() == [1] + [0] * (len(docs) - 1) and again.tokens.tolist() == [len(d) for d in docs]
    n = len(again.alphabet)
    uses = Counter(again.symbols.tolist()) + Counter(again.rules.ravel().tolist())
    assert all((r < n + i).all() for i, r in enumerate(again.rules)) and all(uses[n + i] for i in range(len(again.rules)))
    for d, ids in enumerate(docs):
        assert (again.document(d) == ids).all()
        for a, b in ((0, len(ids)), (3, 9), (len(ids) // 2, len(ids) // 2 + 5), (len(ids) - 1, len(ids) + 5), (5, 5), (-3, 2)):
            assert again.slice(d, a, b).tolist() == ids[max(0, a) : max(0, b)].tolist()
    with pytest.raises(ValueError):
        token_files.Shard.read(body[:-1])
    with pytest.raises(ValueError):
        token_files.Shard.read(b"none" + body[4:])


@pytest.mark.parametrize("shard_tokens", [1, 500, 1 << 20])
def test_token_files_in_order_of_ids(spark, shard_tokens):
    texts = odd_texts(120, 8)
    rows = [(7 * i % 113 - 20 if i % 9 else None, t, None) for i, t in enumerate(texts)] + [(5, None, None), (5, "", None), (5, "same", None), (5, "same", None), (6, "long text " * 30_000, None)]
    docs = frame(spark, rows).repartition(5)
    path = common.scratch(spark, "tokens")
    token_files.write_tokens(docs, path, PATH, 1, split=True, shard_tokens=shard_tokens)
    got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i)) and len(got) == len(rows)
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        start += r["n_tokens"]
    want = Counter((i, (*e, 1)) for (i, _, _), e in zip(rows, whole_text_ids([t or "" for _, t, _ in rows])))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want


def test_token_files_of_an_empty_table(spark):
    path = common.scratch(spark, "tokens")
    token_files.write_tokens(frame(spark, []), path, PATH, 1)
    assert token_files.read_tokens(spark, path).count() == 0
