"""Substring dedup by seed and extend.

Every window of 35 words keeps the least of its 10-gram hashes as its anchor
(winnowing), so equal windows have equal anchors at equal places.  Anchors that
occur once cannot be part of a repeat.  For the others the words around them,
as far as the windows that chose them reach, are the extension: where all
occurrences of an anchor agree on it, the whole stretch repeats; where they
differ, each window is looked up by itself, so that maximal repeats end at the
right word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datascry.llm import annotate, common
from datascry.llm import words as w


def _anchors(part: w.Texts, codes: np.ndarray, window: int, k: int):
    """Anchor hash, text, and first and last window (word positions in ``part``)
    for each stretch of windows that share an anchor."""
    gram = w.grams(codes, k)
    at = w.sliding_argmin(gram, window - k + 1)
    starts = np.flatnonzero(w.whole(part.first, len(at), window))
    at = at[starts]
    new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
    last = np.append(new[1:], len(at)) - 1
    at, lo, hi = at[new], starts[new], starts[last] if len(new) else starts[:0]
    rows = np.searchsorted(part.first, at, "right") - 1
    return gram[at], rows, at, lo, hi


def _runs(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches in the order of text and position, those that touch made one."""
    begins = np.ones(len(row), dtype=bool)
    begins[1:] = (row[1:] != row[:-1]) | (lo[1:] != hi[:-1] + 1)
    at = np.flatnonzero(begins)
    last = np.append(at[1:], len(row))[: len(at)] - 1
    return row[at], lo[at], hi[last]


def _firsts(row: np.ndarray, *codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries that agree in text and codes: the first of each, and all that
    have an equal, in their order."""
    order = np.lexsort((np.arange(len(row)), *codes, row))
    new = np.ones(len(order), dtype=bool)
    for values in (row, *codes):
        new[1:] &= values[order][1:] == values[order][:-1]
    new[1:] = ~new[1:]
    group = np.cumsum(new) - 1
    again = np.bincount(group)[group] > 1 if len(order) else new
    return np.sort(order[new]), np.sort(order[again])


def _anchor_rows(column: pa.Array, window: int, k: int) -> Iterator[tuple[np.ndarray, list]]:
    """Anchor, two stretch hashes, first window and how many follow.

    An anchor comes once for each text and stretch.  Stretches that a text has
    twice or more are settled: those come as runs, without an anchor.
    """
    for base, _, data, offsets in w.chunks(column):
        part = w.Texts(data, offsets)
        codes = part.hashes()
        anchor, rows, at, lo, hi = _anchors(part, codes, window, k)
        # the stretch, and where in it the anchor stands
        place = w._mixed((at - lo).astype(np.uint64))
        around = w.word_spans(codes, lo, hi + window) ^ place
        other = w.other_word_spans(part.other_hashes(), lo, hi + window) ^ place
        one, again = _firsts(rows, anchor, around, other)
        a = part.first[rows]
        yield base + rows[one], [pa.array(w.signed(anchor[one])), w.signed(around[one]), w.signed(other[one]), (lo - a)[one], (hi - lo)[one]]
        row, first, last = _runs(rows[again], (lo - a)[again], (hi - a)[again])
        none = pa.nulls(len(row), pa.int64())
        yield base + row, [none, none, none, first, last - first]


def _window_rows(column: pa.Array, spans: pa.Array, window: int) -> Iterator[tuple[np.ndarray, list]]:
    """The windows that ``spans`` (first, count - 1; one list per text) names.

    A window's hash comes once for each text.  Where a text has a window
    twice or more that settles it: those come as runs ``lo, more`` without hash.
    """
    lists = spans.flatten()
    n = np.diff(np.asarray(spans.offsets))
    lo_all, more_all = (np.asarray(lists.field(i)) for i in (0, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    for base, top, data, offsets in w.chunks(column):
        part = w.Texts(data, offsets)
        codes = part.hashes()
        lo, more = lo_all[at[base] : at[top]], more_all[at[base] : at[top]]
        rows = np.repeat(np.arange(top - base), n[base:top])
        count = more + 1
        each = np.repeat(np.arange(len(lo)), count)
        within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        pos = lo[each] + within
        start = part.first[rows[each]] + pos
        code, row = w.word_spans(codes, start, start + window), rows[each]
        other = w.other_word_spans(part.other_hashes(), start, start + window)
        one, again = _firsts(row, code, other)
        yield base + row[one], [pa.array(w.signed(code[one])), pa.array(w.signed(other[one])), pos[one], np.zeros(len(one), dtype=np.int64)]
        again = again[np.lexsort((pos[again], row[again]))]
        run, first, last = _runs(row[again], pos[again], pos[again])
        none = pa.nulls(len(run), pa.int64())
        yield base + run, [none, none, first, last - first]


def _removed(column: pa.Array, spans: pa.Array, window: int) -> list:
    """Words, words removed, and what is left, for texts with windows ``spans``."""
    n_words, n_removed, kept = [], [], []
    for text, found in zip(column, spans, strict=True):
        said = (text.as_py() or "").encode().split()
        n = len(said)
        gone = 0
        if found.is_valid and len(found.values):
            lo = np.asarray(found.values.field(0))
            hi = lo + np.asarray(found.values.field(1)) + window
            drop = w.covered(n, lo, hi)
            gone = int(drop.sum())
            said = [x for x, d in zip(said, drop.tolist(), strict=True) if not d]
        n_words.append(n)
        n_removed.append(gone)
        kept.append(b" ".join(said))
    return [n_words, n_removed, kept]


def find_repeats(docs: DataFrame, window: int = 35, k: int = 10) -> DataFrame:
    """``doc_id, key, spans``: runs of repeated windows of each text with any.

    ``key`` is the 64-bit hash of the text; ``spans`` has structs ``lo`` (word
    position of the first window) and ``more`` (how many windows follow).
    """
    thin = docs.select("doc_id", common.text_key(F.col("text")).alias("key"), "text")
    anchors = common.cut(
        annotate.emit_rows(
            thin, "text", ["doc_id", "key"], lambda c: _anchor_rows(c, window, k), "anchor long, around long, other long, lo int, more int"
        ),
        "anchors",
    )
    open_anchors = anchors.filter("anchor is not null")
    seeds = (
        open_anchors.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"), ((F.min("around") == F.max("around")) & (F.min("other") == F.max("other"))).alias("alike"))
        .filter("n > 1")
        .drop("n")
    )
    # written before the join, so that a very frequent anchor can be dealt to many tasks; so are windows below
    seeds = common.cut(seeds, "anchor-counts")
    hits = common.cut(
        open_anchors.select("doc_id", "key", "anchor", "lo", "more")
        .join(seeds, "anchor")
        .select("doc_id", "key", "lo", "more", "alike")
        .unionByName(anchors.filter("anchor is null").select("doc_id", "key", "lo", "more", F.lit(True).alias("alike"))),
        "seeded",
    )
    common.release(docs.sparkSession, anchors, seeds)
    span = F.struct("lo", "more")
    open_ends = hits.filter("not alike").distinct().groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    met = thin.join(
        open_ends.select(F.col("doc_id").alias("o_id"), F.col("key").alias("o_key"), "spans"),
        common.same(F.col("doc_id"), F.col("o_id")) & (F.col("key") == F.col("o_key")),
    )

    id_type = docs.schema["doc_id"].dataType.simpleString()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for rows, (code, other, lo, more) in _window_rows(batch.column(2), batch.column(3), window):
                    at = pa.array(rows)
                    arrays = [batch.column(0).take(at), batch.column(1).take(at), code, other, pa.array(lo, pa.int32()), pa.array(more, pa.int32())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", "code", "other", "lo", "more"])

    each = common.cut(
        met.select("doc_id", "key", "text", "spans").mapInArrow(windows, f"doc_id {id_type}, key long, code long, other long, lo int, more int"), "windows"
    )
    common.release(docs.sparkSession)
    coded = each.filter("code is not null")
    twice = coded.groupBy("code", "other").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("code", "other")
    twice = common.cut(twice, "windows-twice")
    ends = coded.select("doc_id", "key", "lo", "more", "code", "other").join(twice, ["code", "other"], "left_semi").select("doc_id", "key", "lo", "more")
    ends = ends.unionByName(each.filter("code is null").select("doc_id", "key", "lo", "more"))
    spans = common.cut(
        hits.filter("alike")
        .select("doc_id", "key", "lo", "more")
        .unionByName(ends)
        .groupBy("doc_id", "key")
        .agg(F.collect_set(span).alias("spans")),
        "spans",
    )
    common.release(docs.sparkSession, hits, each, twice)
    return spans


def remove_repeats(
    docs: DataFrame, keep: list[str] | None = None, window: int = 35, k: int = 10
) -> DataFrame:
    """``docs`` (columns ``keep``) with ``n_words, n_removed, kept_text``.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A word goes if it lies in a window of
    ``window`` consecutive words of its document whose words also start
    anywhere else, the same document included.  ``kept_text`` has the other
    words, joined by one space.

    Null and empty texts have no words.  Rows repeat one another's windows
    even where they agree in id and text; such rows get equal results.  An
    empty table gives no rows; clashing new columns get leading underscores.
    Equality of windows is that of two hashes, 122 bits together.
    """
    kept = list(docs.columns if keep is None else keep)
    n_words, n_removed, kept_text = common.fresh(docs.select(*[annotate._quoted(c) for c in kept]), "n_words", "n_removed", "kept_text")
    spans = find_repeats(docs, window, k).select(F.col("doc_id").alias("s_id"), F.col("key").alias("s_key"), "spans")
    carried = docs.select(
        F.struct(*[F.col(annotate._quoted(c)) for c in kept]).alias("row"),
        F.col("doc_id"),
        common.text_key(F.col("text")).alias("key"),
        F.col("text"),
    )
    joined = carried.join(
        spans, common.same(F.col("doc_id"), F.col("s_id")) & (F.col("key") == F.col("s_key")), "left"
    ).select("row", "text", "spans")
    schema = f"row {joined.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, gone, left = _removed(part.column(1), part.column(2), window)
                arrays = [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(run, schema).select(
        "row.*",
        F.col("n_words").alias(n_words),
        F.col("n_removed").alias(n_removed),
        F.col("kept_text").alias(kept_text),
    )
