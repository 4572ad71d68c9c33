"""Benchmark decontamination by winnowing.

Of every window of 10 words the least 5-gram hash is kept as a fingerprint,
in documents and benchmark items alike, so any 10 words they share have a
fingerprint in common.  Documents and items are joined on fingerprints, and a hit is
extended to the windows that keep it: each is looked up among the distinct windows of
all items, so a passage that many items share is met once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datascry.llm import annotate, common
from datascry.llm import words as w


def _texts(column: pa.Array) -> Iterator[tuple[int, w.Texts]]:
    for lo, _, data, offsets in w.chunks(column):
        yield lo, w.Texts(data, offsets, w.ALNUM, lower=True)


def fingerprints(first: np.ndarray, hashes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams kept from texts of at least a window."""
    gram = w.grams(hashes, k)
    at = w.sliding_argmin(gram, window - k + 1)
    at = at[w.whole(first, len(at), window)]
    at = at[np.flatnonzero(np.diff(at, prepend=-1))] if len(at) else at
    return at, gram[at]


class Windows:
    """The distinct windows of one size: two hashes each, the place of one in the
    index's words, and the items that have it, from ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, code: np.ndarray, other: np.ndarray, place: np.ndarray, item: np.ndarray):
        order = np.lexsort((item, other, code))
        code, other, place, item = code[order], other[order], place[order], item[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (code[1:] != code[:-1]) | (other[1:] != other[:-1])
        once = new.copy()
        once[1:] |= item[1:] != item[:-1]
        self.code, self.other, self.place = code[new], other[new], place[new]
        self.items = item[once]
        self.first = np.append(np.flatnonzero(new[once]), len(self.items))

    def places(self, code: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Which window each pair of hashes is, or -1."""
        lo, hi = (np.searchsorted(self.code, code, side) for side in ("left", "right"))
        out = np.full(len(code), -1)
        for step in range(int((hi - lo).max(initial=0))):
            at = np.minimum(lo + step, len(self.code) - 1)
            out = np.where((lo + step < hi) & (self.other[at] == other), at, out)
        return out


class Index:
    """Fingerprints and distinct windows of all items; an item shorter than a window
    is one window by itself.

    All is held in flat arrays, about 60 bytes a word: the words' bytes are in ``data``.
    """

    def __init__(self, ids: list[str], texts: pa.Array, window: int = 10, k: int = 5):
        self.window, self.k = window, k
        self.ids = ids
        lengths, data, prints = [], [], []
        rows: dict[int, list] = {}
        words = items = 0
        for _, part in _texts(texts):
            codes, others, n = part.hashes(), part.other_hashes(), part.n_words
            _, found = fingerprints(part.first, codes, window, k)
            prints.append(np.unique(found))
            for size in np.unique(np.minimum(n[n > 0], window)).tolist():
                start = np.flatnonzero(w.whole(part.first, max(0, len(codes) - size + 1), size))
                row = np.searchsorted(part.first, start, "right") - 1
                mine = (n[row] >= window) if size == window else (n[row] == size)
                start, row = start[mine], row[mine]
                pair = [w.word_spans(codes, start, start + size), w.other_word_spans(others, start, start + size)]
                rows.setdefault(size, []).append([*pair, start + words, row + items])
            lengths.append(part.ends - part.starts)
            data.append(part.data[w.covered(len(part.data), part.starts, part.ends)])
            words += len(codes)
            items += len(n)
        self.data = np.concatenate(data) if data else np.zeros(0, dtype=np.uint8)
        self.byte = np.concatenate([[0], np.cumsum(np.concatenate(lengths) if lengths else [])]).astype(np.int64)
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, dtype=np.uint64)
        self.windows = {size: Windows(*[np.concatenate(x) for x in zip(*parts, strict=True)]) for size, parts in rows.items()}

    def word(self, i: int) -> bytes:
        return self.data[self.byte[i] : self.byte[i + 1]].tobytes()

    def find(self, part: w.Texts) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """``size, starts, windows``: the words of ``part`` at which verified windows start."""
        codes, out = part.hashes(), []
        for size, known in self.windows.items():
            if size == self.window:
                gram = w.grams(codes, self.k)
                at = w.sliding_argmin(gram, self.window - self.k + 1)
                start = np.flatnonzero(w.whole(part.first, len(at), self.window))
                mine = gram[at[start]]
                spot = np.minimum(np.searchsorted(self.prints, mine), len(self.prints) - 1)
                start = start[self.prints[spot] == mine]
            else:
                start = np.flatnonzero(w.whole(part.first, max(0, len(codes) - size + 1), size))
            if len(start):
                code, other = w.word_spans(codes, start, start + size), w.other_word_spans(part.other_hashes(), start, start + size)
                which = known.places(code, other)
                start, which = start[which >= 0], which[which >= 0]
                same = [
                    all(part.word(q + i) == self.word(p + i) for i in range(size))
                    for q, p in zip(start.tolist(), known.place[which].tolist(), strict=True)
                ]
                out.append((size, start[same], which[same]))
        return out


FIELDS = "n_words long, n_hit long, item_ids array<string>"


def _annotated(column: pa.Array, index: Index) -> list[pa.Array]:
    n_words: list[int] = []
    n_hit: list[int] = []
    items: list[list[str]] = []
    for _, part in _texts(column):
        hits = index.find(part)
        starts = np.concatenate([at for _, at, _ in hits]) if hits else np.zeros(0, dtype=np.int64)
        ends = np.concatenate([at + size for size, at, _ in hits]) if hits else starts
        hit = np.concatenate([[0], np.cumsum(w.covered(len(part.starts), starts, ends))])
        n_words += part.n_words.tolist()
        n_hit += (hit[part.first[1:]] - hit[part.first[:-1]]).tolist()
        found: list[set[int]] = [set() for _ in range(len(part))]
        for size, at, which in hits:
            known = index.windows[size]
            row = np.searchsorted(part.first, at, "right") - 1
            # a window that a text has many times names its items once
            for r, i in {*zip(row.tolist(), which.tolist(), strict=True)}:
                found[r].update(known.items[known.first[i] : known.first[i + 1]].tolist())
        items += [sorted({index.ids[i] for i in x}) for x in found]
    return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))]


def mark_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str] | None = None,
    window: int = 10,
    k: int = 5,
    max_broadcast_bytes: int = 8 << 20,
) -> DataFrame:
    """``docs`` (columns ``keep``) with ``n_words, n_hit, item_ids, contaminated``.

    Words are runs of ASCII letters (lower-cased), digits and anything beyond
    ASCII.  A document word within any occurrence of an item's window (10
    consecutive words; all words of a shorter item) is hit.  ``item_ids`` are the
    items with occurring windows, as sorted distinct strings.

    Null and empty texts have no words; items without words match nothing;
    repeated items and rows count like any others.  A null item_id is the
    string ``""``.  An empty benchmark hits nothing.  New columns that clash
    with kept ones get leading underscores.

    The benchmark's texts are measured: up to ``max_broadcast_bytes`` the index
    goes to every worker (some ten times as many bytes there) and documents
    stay where they are; beyond it, fingerprints are shuffled and joined.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").alias("item_text"))
    size = items.agg(F.sum(F.octet_length("item_text") + F.octet_length("item_id"))).first()[0] or 0
    if size <= max_broadcast_bytes:
        rows = items.filter("item_text is not null").collect()
        index = docs.sparkSession.sparkContext.broadcast(
            Index([r.item_id for r in rows], pa.array([r.item_text for r in rows], pa.string()), window, k)
        )
        out = annotate.add_columns(docs, "text", lambda column: _annotated(column, index.value), FIELDS, keep)
    else:
        out = _by_join(docs, items, keep, window, k)
    n_hit = out.columns[-2]
    (flag,) = common.fresh(out, "contaminated")
    return out.withColumn(flag, F.col(n_hit) > 0)


def _windows(part: w.Texts, codes: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> list[np.ndarray]:
    """The two hashes, 122 bits together, of the runs of ``size`` words from ``start``."""
    return [w.signed(w.word_spans(codes, start, start + size)), w.signed(w.other_word_spans(part.other_hashes(), start, start + size))]


def _item_windows(column: pa.Array, window: int) -> Iterator[tuple[np.ndarray, list]]:
    """``size, code, other`` of every window of an item."""
    for lo, part in _texts(column):
        codes, n = part.hashes(), part.n_words
        size = np.minimum(n, window)
        count = np.where(n > 0, n - size + 1, 0)
        row = np.repeat(np.arange(len(n)), count)
        start = part.first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        yield lo + row, [size[row], *_windows(part, codes, start, size[row])]


def _item_prints(column: pa.Array, window: int, k: int) -> Iterator[tuple[np.ndarray, list]]:
    for lo, part in _texts(column):
        at, prints = fingerprints(part.first, part.hashes(), window, k)
        yield lo + np.searchsorted(part.first, at, "right") - 1, [w.signed(prints)]


def _doc_prints(column: pa.Array, window: int, k: int) -> Iterator[tuple[np.ndarray, list]]:
    """``print, lo, more``: the windows (first, and how many follow) that keep each fingerprint."""
    for base, part in _texts(column):
        gram = w.grams(part.hashes(), k)
        at = w.sliding_argmin(gram, window - k + 1)
        starts = np.flatnonzero(w.whole(part.first, len(at), window))
        at = at[starts]
        new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
        last = np.append(new[1:], len(at))[: len(new)] - 1
        rows = np.searchsorted(part.first, starts[new], "right") - 1
        yield base + rows, [w.signed(gram[at[new]]), starts[new] - part.first[rows], starts[last] - starts[new]]


def _by_join(docs: DataFrame, items: DataFrame, keep: list[str] | None, window: int, k: int) -> DataFrame:
    """The same by shuffled fingerprints, for benchmarks too large to broadcast.

    A fingerprint in common names the few windows of a document that may occur
    in an item; those are looked up by 122 bits of hash among the distinct
    windows of all items.  So a document meets items only through windows
    that do occur, and what is frequent is counted once before it is joined.
    """
    kept = list(docs.columns if keep is None else keep)
    item_windows = common.cut(
        annotate.emit_rows(items, "item_text", ["item_id"], lambda c: _item_windows(c, window), "size long, code long, other long").distinct(), "item-windows"
    )
    distinct = common.cut(item_windows.select("size", "code", "other").distinct(), "item-distinct")
    prints = common.cut(
        annotate.emit_rows(items, "item_text", [], lambda c: _item_prints(c, window, k), "print long").distinct(), "item-prints"
    )
    short = sorted(r[0] for r in distinct.filter(F.col("size") < window).select("size").distinct().collect())  # a window's worth at most
    key, d = common.fresh(docs, "row_key", "row_id")
    keyed = docs.withColumns({d: F.col("doc_id"), key: common.text_key(F.col("text"))})
    thin = keyed.select(F.col(d).alias("d"), F.col(key).alias("key"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    met = (
        annotate.emit_rows(thin, "text", ["d", "key"], lambda c: _doc_prints(c, window, k), "print long, lo int, more int")
        .join(prints, "print", "left_semi")
        .groupBy("d", "key")
        .agg(F.collect_set(F.struct("lo", "more")).alias("spans"))
        .withColumnsRenamed({"d": "s_d", "key": "s_key"})
    )
    with_spans = thin.join(met, common.same(F.col("d"), F.col("s_d")) & (F.col("key") == F.col("s_key")), "left" if short else "inner")

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, part in _texts(batch.column(2)):
                codes = part.hashes()
                rows, pos, size = [], [], []
                for i in range(len(part)):
                    spans = batch.column(3)[base + i]
                    if spans.is_valid and len(spans.values):
                        lo, more = (np.asarray(spans.values.field(f)) for f in (0, 1))
                        each = np.repeat(lo, more + 1) + np.arange(int((more + 1).sum())) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
                        rows.append(np.full(len(each), i))
                        pos.append(each)
                        size.append(np.full(len(each), window))
                for n in short:
                    start = np.flatnonzero(w.whole(part.first, max(0, len(codes) - n + 1), n))
                    row = np.searchsorted(part.first, start, "right") - 1
                    rows.append(row)
                    pos.append(start - part.first[row])
                    size.append(np.full(len(start), n))
                if not rows:
                    continue
                row, at, n = np.concatenate(rows), np.concatenate(pos).astype(np.int64), np.concatenate(size)
                code, other = _windows(part, codes, part.first[row] + at, n)
                where = pa.array(base + row)
                arrays = [batch.column(0).take(where), batch.column(1).take(where), pa.array(n), pa.array(code), pa.array(other), pa.array(at)]
                yield pa.RecordBatch.from_arrays(arrays, names=["d", "key", "size", "code", "other", "pos"])

    hits = common.cut(
        with_spans.select("d", "key", "text", "spans")
        .mapInArrow(looked_up, f"d {id_type}, key long, size long, code long, other long, pos long")
        .join(distinct, ["size", "code", "other"], "left_semi"),
        "item-hits",
    )
    places = hits.groupBy("d", "key").agg(F.collect_set(F.struct(F.col("pos").alias("a"), (F.col("pos") + F.col("size")).alias("b"))).alias("f_spans"))
    named = (
        hits.select("d", "key", "size", "code", "other").distinct()
        .join(item_windows, ["size", "code", "other"])
        .groupBy("d", "key")
        .agg(F.sort_array(F.collect_set("item_id")).alias("f_items"))
        .withColumnsRenamed({"d": "n_d", "key": "n_key"})
    )
    found = places.join(named, common.same(F.col("d"), F.col("n_d")) & (F.col("key") == F.col("n_key")))
    found = common.cut(found.select(F.col("d").alias("f_d"), F.col("key").alias("f_key"), "f_spans", "f_items"), "item-found")
    merged = F.aggregate(
        F.sort_array("f_spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(s["a"], acc["upto"]))).alias("n"),
            F.greatest(acc["upto"], s["b"]).alias("upto"),
        ),
    )["n"]
    counted = annotate.add_columns(
        keyed, "text", lambda c: [pa.array(np.concatenate([p.n_words for _, p in _texts(c)]))], "n_words long", [*dict.fromkeys([*kept, d, key])]
    )
    common.release(docs.sparkSession, item_windows, distinct, prints, hits)
    n_words = counted.columns[-1]
    joined = counted.join(found, common.same(F.col(d), F.col("f_d")) & (F.col(key) == F.col("f_key")), "left")
    quoted = [annotate._quoted(c) for c in kept]
    _, n_hit, item_ids = common.fresh(docs.select(*quoted), "n_words", "n_hit", "item_ids")
    empty = F.array().cast("array<string>")
    return joined.select(
        *quoted, annotate._quoted(n_words), F.coalesce(merged, F.lit(0).cast("long")).alias(n_hit), F.coalesce("f_items", empty).alias(item_ids)
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents with no word inside an occurrence of a benchmark window."""
    marked = mark_contaminated(docs, benchmark, **options)
    return marked.filter(~F.col(marked.columns[-1])).select(*[annotate._quoted(c) for c in docs.columns])
