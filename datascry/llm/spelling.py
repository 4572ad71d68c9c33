"""Words that differ by one edit, grouped under the spelling that is far more frequent.

One edit between two words of m and of m or m + 1 code points leaves the
first or the last m // 2 code points as they are.  So words are listed in two
sorted dictionaries, forward and reversed, and near words stand in a stretch
of equal prefix in one of them; a stretch that is too large is divided again
by the same rule, applied to what lies between the shared ends.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datascry.llm import common
from datascry.llm.annotate import _quoted
from datascry.llm.words import LOWER, Texts, chunks

LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
#: Words held in a task before their counts are sent on.
MOST_HELD = 400_000
#: Stretches of more words are divided by Spark; of more than FEW, within their task.
MOST_BLOCK, FEW = 20_000, 24

#: Bytes of ASCII letters, lower-cased; all letters beyond are a C3 byte and its follower.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x61:0x7B] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def crc32_each(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """crc32 of each ``data[start:end]``, carried on from the values ``begun``."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    state, at, size = ~begun[order].astype(np.uint32), starts[order], size[order]
    long = int(np.searchsorted(-size, -64))  # those of over 64 bytes one by one
    out = np.empty(len(order), dtype=np.uint32)
    for i in range(long):
        out[order[i]] = zlib.crc32(data[at[i] : at[i] + size[i]].tobytes(), int(~state[i]))
    for k in range(int(size[long]) if long < len(size) else 0):
        m = int(np.searchsorted(-size, -k))  # as many have a byte at place k
        part = state[long:m]
        state[long:m] = _CRC[(part ^ data[at[long:m] + k]) & np.uint32(0xFF)] ^ (part >> np.uint32(8))
    out[order[long:]] = ~state[long:]
    return out


def runs_of_letters(ids: Sequence, texts: pa.Array, least_chars: int, drop_every: int | None) -> Iterator[list[bytes]]:
    """Runs of ``[A-Za-z\\u00C0-\\u00FF]`` of at least ``least_chars`` code points, ASCII in
    lower case; with ``drop_every`` those whose crc32 it divides lose a code point."""
    for lo, hi, data, offsets in chunks(texts):
        low = LOWER[data]
        lead = low == 0xC3
        inside = _LETTER[low] | lead
        inside[1:] |= lead[:-1]
        t = Texts(np.where(inside, low, np.uint8(0x20)), offsets)
        leads = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(lead, out=leads[1:])
        chars = t.ends - t.starts - (leads[t.ends] - leads[t.starts])
        long = np.flatnonzero(chars >= least_chars)
        starts, ends, raw = t.starts[long], t.ends[long], t.data.tobytes()
        words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        if drop_every and words:
            begun = np.array([zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode())) for i in ids[lo:hi]], dtype=np.uint32)
            h = crc32_each(t.data, starts, ends, begun[t.rows()[long]])
            gone = []
            for i in np.flatnonzero(h % np.uint32(drop_every) == 0).tolist():
                word = words[i].decode()
                place = int(h[i]) % len(word)
                words[i] = (word[:place] + word[place + 1 :]).encode()
                if len(word) <= least_chars:
                    gone.append(i)
            for i in reversed(gone):
                del words[i]
        yield words


def count_words(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, drop_every: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``word, n`` of the distinct runs of letters in all whole texts (null: none).

    ``drop_every`` plants errors: where it divides the crc32 of ``<id>:<run>`` (a null
    id is empty), the run loses the code point at that crc32 modulo its length.
    """
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array(list(held.keys()), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for words in runs_of_letters(batch.column(0).to_pylist(), batch.column(1), least_chars, drop_every):
                held.update(words)
                if len(held) > MOST_HELD:
                    yield out()
                    held.clear()
        yield out()

    each = docs.select(docs[_quoted(id_col)], docs[_quoted(text_col)]).mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def one_edit(u: str, v: str) -> bool:
    """Whether u, no longer than v, becomes v by one inserted or replaced code point."""
    if len(v) - len(u) not in (0, 1) or u == v:
        return False
    i = 0
    while i < len(u) and u[i] == v[i]:
        i += 1
    return u[i + (len(u) == len(v)) :] == v[i + 1 :]


def _ends(m: int, path: str) -> tuple[int, int]:
    """How many code points at the beginning and end a stretch of this path shares."""
    a = b = 0
    for side in path:
        half = (m - a - b) // 2
        a, b = (a + half, b) if side == "p" else (a, b + half)
    return a, b


def _first_path(u: str, v: str, m: int, path: str) -> bool:
    """Whether the pair takes this path if it prefers prefixes: it does so on one path alone."""
    a = b = 0
    for side in path:
        half = (m - a - b) // 2
        if side == "p":
            a += half
        elif u[a : a + half] == v[a : a + half]:
            return False
        else:
            b += half
    return True


def near_in_block(block: list[tuple[str, int]], m: int, path: str) -> Iterator[tuple[str, int, str, int]]:
    """Pairs of near words, the first of m code points, that this stretch is to find."""
    short = [x for x in block if len(x[0]) == m]
    if not short or len(block) < 2:
        return
    a, b = _ends(m, path)
    half = (m - a - b) // 2
    if len(block) > FEW and half:
        for side in "ps":
            parts = defaultdict(list)
            for x in block:
                w = x[0]
                parts[w[a : a + half] if side == "p" else w[len(w) - b - half : len(w) - b]].append(x)
            for part in parts.values():
                yield from near_in_block(part, m, path + side)
        return
    for i, (u, nu) in enumerate(short):
        for v, nv in short[i + 1 :]:
            if one_edit(u, v) and _first_path(u, v, m, path):
                yield u, nu, v, nv
    for v, nv in (x for x in block if len(x[0]) > m):
        for u, nu in short:
            if one_edit(u, v) and _first_path(u, v, m, path):
                yield u, nu, v, nv


_PAIRS = "word string, near string, near_n long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Goes through sorted entries; a stretch may reach over several batches."""
    found: list[tuple[str, str, int]] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["word", "near", "near_n"])

    block: list[tuple[str, int]] = []
    at = None
    for batch in batches:
        for m, path, key, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (m, path, key) != at:
                if at is not None and len(block) > 1:
                    for u, nu, v, nv in near_in_block(block, at[0], at[1]):
                        found += [(u, v, nv), (v, u, nu)]
                block, at = [], (m, path, key)
            block.append((word, n))
        if len(found) > 20_000:
            yield out()
            found.clear()
    if at is not None and len(block) > 1:
        for u, nu, v, nv in near_in_block(block, at[0], at[1]):
            found += [(u, v, nv), (v, u, nu)]
    yield out()


def _divided(entries: DataFrame) -> DataFrame:
    """Each entry under its two halves: of the word at first, then of what lies between the shared ends."""
    half = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    sides = F.array(
        F.struct(F.concat("path", F.lit("p")).alias("path"), (F.col("a") + half).alias("a"), F.col("b").alias("b")),
        F.struct(F.concat("path", F.lit("s")).alias("path"), F.col("a").alias("a"), (F.col("b") + half).alias("b")),
    )
    each = entries.select("word", "n", "m", F.inline(sides))
    # the reversed dictionary is in the order of words read backwards
    key = F.concat(F.substring(F.reverse("word"), F.lit(1), F.col("b")), F.lit("\n"), F.substring("word", F.lit(1), F.col("a")))
    return each.withColumn("key", key)


def near_words(words: DataFrame, most_block: int = MOST_BLOCK) -> DataFrame:
    """``word, near, near_n`` for all ordered pairs of ``words`` (``word, n``) that differ by
    exactly one inserted, deleted or replaced code point.

    A word of L code points stands in the stretches of length classes L (with
    those of L + 1) and L - 1.  Stretches of over ``most_block`` words are counted
    first and divided, round by round, until none is left that can be divided;
    beyond that a stretch has at most one free code point, or two.
    """
    length = F.char_length("word")
    classes = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).filter("m > 0")
    entries = _divided(classes.selectExpr("word", "n", "m", "'' as path", "0 as a", "0 as b"))
    at = ["m", "path", "key"]
    out = None
    while True:
        large = common.cut(entries.filter("m - a - b >= 2").groupBy(*at).agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > most_block).select(*at), "stretches")
        if large.isEmpty():
            out = entries if out is None else out.unionByName(entries)
            break
        rest = entries.join(large, at, "left_anti")
        out = rest if out is None else out.unionByName(rest)
        entries = common.cut(_divided(entries.join(large, at, "left_semi")), "divided")
    ordered = out.select(*at, "word", "n").repartitionByRange(*at).sortWithinPartitions(*at)
    return ordered.mapInArrow(_scan, _PAIRS)


def with_roots(forms: DataFrame) -> DataFrame:
    """Adds ``root``, where following ``form`` from ``word`` ends (the word itself without form).

    Links are followed in leaps that double; each form is several times as frequent as
    its word, so chains are short.
    """
    links = common.cut(forms.filter("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        leap = links.alias("l").join(links.select(F.col("word").alias("root"), F.col("root").alias("further")).alias("r"), "root", "left")
        leapt = common.cut(leap.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        links = leapt.select("word", "root")
        if leapt.filter("moved").isEmpty():
            break
    return forms.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each of ``words`` (``word, n``; words distinct).

    ``form`` is the most frequent near word (ties: first in code-point order) if it is
    ``ratio`` times as frequent, else null; ``n_near`` counts near words.
    """
    words = common.cut(words, "words")
    near = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    )
    frequent = -F.col("best.less") >= ratio * F.col("n")
    forms = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n"),
    )
    return with_roots(common.cut(forms, "variants")).select("word", "form", "root", "n", "n_near", "form_n")
