"""Line dedup over content-defined chunks of lines, extended to whole repeated runs.

:func:`remove_repeated_lines` looks up chunks first: a rolling hash over line hashes
ends them, so boundaries shift with the text.  Chunks whose digest occurs
again anywhere are compared byte by byte; of equal ones the first stays.  Only
first chunks are searched further, line by line: a stretch of a few lines of
theirs that begins before goes too, and stretches that overlap or touch extend a
chunk both ways, so a run goes whole wherever it stands and whatever is around it.

:func:`remove_repeated_chunks` stops after the chunks.  A run that shares a
chunk with other lines stays: it is the coarser rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datascry.llm import annotate, common
from datascry.llm import words as w


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (without the break) of lines, the text of each, and the
    first line of each text.  A text of n breaks has n + 1 lines, an empty one none."""
    breaks = np.flatnonzero(data == 0x0A)
    text_of = np.searchsorted(offsets, breaks, "right") - 1
    full = np.flatnonzero(np.diff(offsets) > 0)
    starts = np.concatenate([offsets[full], breaks + 1])
    rows = np.concatenate([full, text_of])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = np.concatenate([breaks, offsets[full + 1]])
    ends = ends[np.lexsort((ends, np.concatenate([text_of, full])))]
    return starts, ends, rows, np.searchsorted(rows, np.arange(len(offsets)))


def chunk_lines(
    data: np.ndarray, offsets: np.ndarray, span: int, mean: int, most: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First line, line after the last and text of each chunk, and hash of each line.

    A chunk ends after a line at which the hash of the last ``span`` lines is 0
    modulo ``mean``, at the text's end, or after ``most`` lines.
    """
    starts, ends, rows, first = _lines(data, offsets)
    codes = w.byte_spans(data, starts, ends)
    # the rolling hash of a text's first lines covers what there is
    begin = np.maximum(np.arange(len(codes)) - span + 1, first[rows]) if len(codes) else np.zeros(0, dtype=np.int64)
    rolling = w.word_spans(codes, begin, np.arange(len(codes)) + 1)
    stop = rolling % np.uint64(mean) == 0
    stop[first[1:][np.diff(first) > 0] - 1] = True
    lo = np.concatenate([[0], np.flatnonzero(stop) + 1])[: int(stop.sum())]
    hi = np.flatnonzero(stop) + 1
    long = np.flatnonzero(hi - lo > most)
    if len(long):
        more = np.concatenate([np.arange(lo[i] + most, hi[i], most) for i in long])
        hi = np.sort(np.concatenate([hi, more]))
        lo = np.concatenate([[0], hi[:-1]])
    return lo, hi, rows[lo] if len(lo) else lo, codes


class Chunker:
    """The parameters, and what a worker does with a text under them."""

    def __init__(self, span: int = 2, mean: int = 3, most: int = 64, least_lines: int = 2, reach: int = 0):
        """``reach``: lines after a chunk's last that belong to it as well as to the next."""
        self.span, self.mean, self.most, self.least_lines, self.reach = span, mean, most, least_lines, reach

    def chunks(self, column: pa.Array):
        for base, data, starts, ends, lo, hi, rows, number, codes in self._cut(column):
            yield base, data, starts, ends, lo, hi, rows, number, w.word_spans(codes, lo, hi)

    def _cut(self, column: pa.Array):
        for base, _, data, offsets in w.chunks(column):
            starts, ends, _, first = _lines(data, offsets)
            lo, hi, rows, codes = chunk_lines(data, offsets, self.span, self.mean, self.most)
            if self.reach:
                hi = np.minimum(hi + self.reach, first[rows + 1])
            number = np.arange(len(lo)) - np.searchsorted(rows, rows)
            yield base, data, starts, ends, lo, hi, rows, number, codes

    def digests(self, column: pa.Array) -> Iterator[tuple[np.ndarray, list]]:
        """Number and digest of each chunk of several lines."""
        for base, _, starts, ends, lo, hi, rows, number, codes in self.chunks(column):
            at = np.flatnonzero(hi - lo >= self.least_lines)
            yield base + rows[at], [number[at], w.signed(codes[at])]

    def seeds(self, column: pa.Array) -> Iterator[tuple[np.ndarray, list]]:
        """Number, digest and first line of each chunk of several lines, and the digests of
        the stretches of ``least_lines`` lines in it."""
        for base, _, _, _, lo, hi, rows, number, codes in self._cut(column):
            first = lo[np.searchsorted(rows, rows)] if len(rows) else lo
            at = np.flatnonzero(hi - lo >= self.least_lines)
            lo, hi, rows = lo[at], hi[at], rows[at]
            n = hi - lo - self.least_lines + 1
            ends = np.cumsum(n)
            begin = np.arange(n.sum()) + np.repeat(lo - (ends - n), n)
            flat = pa.array(w.signed(w.word_spans(codes, begin, begin + self.least_lines)), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), flat)
            yield base + rows, [number[at], w.signed(w.word_spans(codes, lo, hi)), lo - first[at], lists]

    def texts(self, column: pa.Array, wanted: pa.Array) -> Iterator[tuple[np.ndarray, list]]:
        """Number, digest and bytes of the chunks that ``wanted`` numbers for each text."""
        lists = [set(x.as_py() or ()) for x in wanted]
        for base, data, starts, ends, lo, hi, rows, number, codes in self.chunks(column):
            at = np.array([i for i in range(len(lo)) if int(number[i]) in lists[base + rows[i]]], dtype=np.int64)
            said = [data[starts[lo[i]] : ends[hi[i] - 1]].tobytes() for i in at]
            yield base + rows[at], [number[at], w.signed(codes[at]), pa.array(said, pa.binary())]

    def without(self, column: pa.Array, gone: pa.Array) -> tuple[list, list, list]:
        """Texts without the chunks that ``gone`` numbers; lines and lines removed."""
        lists = [set(x.as_py() or ()) for x in gone]
        left: list = [x if len(y) == 0 else [] for x, y in zip(column.to_pylist(), lists, strict=True)]
        n_lines, n_gone = [0] * len(lists), [0] * len(lists)
        for base, data, starts, ends, lo, hi, rows, number, _ in self.chunks(column):
            for i in range(len(lo)):
                row = base + int(rows[i])
                n_lines[row] += int(hi[i] - lo[i])
                if int(number[i]) in lists[row]:
                    n_gone[row] += int(hi[i] - lo[i])
                elif lists[row]:
                    left[row].append(data[starts[lo[i]] : ends[hi[i] - 1]].tobytes())
        left = [b"\n".join(x).decode() if isinstance(x, list) else x for x in left]
        return left, n_lines, n_gone


class Stretches:
    """Stretches of ``least_lines`` lines, numbered by their first line; their digests
    come with :meth:`Chunker.seeds`."""

    def __init__(self, least_lines: int = 2):
        self.least_lines = least_lines

    def texts(self, column: pa.Array, wanted: pa.Array) -> Iterator[tuple[np.ndarray, list]]:
        """Number, digest and bytes of the stretches that ``wanted`` numbers for each text."""
        lists = [np.asarray(x.values) if x.is_valid else np.zeros(0, dtype=np.int64) for x in wanted]
        for base, _, data, offsets in w.chunks(column):
            starts, ends, _, first = _lines(data, offsets)
            mine = lists[base : base + len(first) - 1]
            number = np.concatenate(mine).astype(np.int64)
            row = np.repeat(np.arange(len(mine)), [len(x) for x in mine])
            at = first[row] + number
            codes = w.byte_spans(data, starts, ends)
            lo, hi = starts[at].tolist(), ends[at + self.least_lines - 1].tolist()
            whole = data.tobytes()
            said = pa.array([whole[a:b] for a, b in zip(lo, hi, strict=True)], pa.binary())
            yield base + row, [number, w.signed(w.word_spans(codes, at, at + self.least_lines)), said]

    def without(self, column: pa.Array, gone: pa.Array) -> tuple[list, list, list]:
        """Texts without the lines of stretches that ``gone`` numbers; lines and lines removed."""
        left, n_lines, n_gone = column.to_pylist(), [], []
        for i, (text, found) in enumerate(zip(left, gone, strict=True)):
            n = text.count("\n") + 1 if text else 0
            n_lines.append(n)
            n_gone.append(0)
            if found.is_valid and len(found.values):
                lo = np.asarray(found.values)
                drop = w.covered(n, lo, lo + self.least_lines)
                n_gone[i] = int(drop.sum())
                left[i] = "\n".join(x for x, d in zip(text.split("\n"), drop.tolist(), strict=True) if not d)
        return left, n_lines, n_gone


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", common.text_key(F.col("text")).alias("key"), "text")


def _repeats(thin: DataFrame, numbers: DataFrame, texts: Callable) -> DataFrame:
    """``doc_id, key, number`` of pieces whose bytes begin before, of the pieces that
    ``numbers`` names (``doc_id, key, number, digest``); ``texts(texts, numbers)`` reads their bytes."""
    id_type = thin.schema["doc_id"].dataType.simpleString()
    # what is known of a digest is written before the join, so that a very frequent one can be dealt to many tasks
    repeated = numbers.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    repeated = common.cut(repeated, "line-repeated")
    wanted = (
        numbers.join(repeated, "digest")
        .groupBy("doc_id", "key")
        .agg(F.collect_set("number").alias("numbers"))
        .select(F.col("doc_id").alias("w_id"), F.col("key").alias("w_key"), "numbers")
    )
    met = thin.join(wanted, common.same(F.col("doc_id"), F.col("w_id")) & (F.col("key") == F.col("w_key")))

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for rows, new in texts(batch.column(2), batch.column(3)):
                    at = pa.array(rows)
                    arrays = [batch.column(0).take(at), batch.column(1).take(at), pa.array(new[0], pa.int32()), pa.array(new[1]), new[2]]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", "number", "digest", "said"])

    found = common.cut(
        met.select("doc_id", "key", "text", "numbers").mapInArrow(
            said, f"doc_id {id_type}, key long, number int, digest long, said binary"
        ),
        "line-piece-bytes",
    )
    # grouping by the bytes themselves is the comparison; copies meet before the shuffle
    where = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key", "number")
    firsts = (
        found.groupBy("digest", "said")
        .agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", F.sha2("said", 256).alias("sha"), "first")
    )
    firsts = common.cut(firsts, "line-firsts")
    common.release(thin.sparkSession, repeated)
    later = (
        found.select("doc_id", "key", "number", "digest", F.sha2("said", 256).alias("sha"))
        .join(firsts, ["digest", "sha"])
        .filter(~where.eqNullSafe(F.col("first")))
        .select("doc_id", "key", "number")
        .distinct()
    )
    out = common.cut(later, "line-later")
    common.release(thin.sparkSession, found, firsts)
    return out


def remove_repeated_lines(docs: DataFrame, least_lines: int = 2) -> DataFrame:
    """``docs`` with its texts cleaned, and ``n_lines, n_lines_removed``.

    A line goes if it lies in a run of at least ``least_lines`` consecutive lines
    whose bytes begin before as such a run: at an earlier line of the same text,
    or in a document with a smaller id (then text hash; null ids come last).  The
    first occurrence of each line stays.  All else is as for :func:`remove_repeated_chunks`.
    """
    chunker, cutter = Chunker(least_lines=least_lines, reach=least_lines - 1), Stretches(least_lines)
    thin = _keyed(docs)
    # a chunk brings its stretches along, so that those of first chunks are known without their texts
    seeds = common.cut(
        annotate.emit_rows(thin, "text", ["doc_id", "key"], chunker.seeds, "number int, digest long, line int, stretches array<long>"),
        "line-seeds",
    )
    later = _repeats(thin, seeds.select("doc_id", "key", "number", "digest"), chunker.texts)
    later = later.select(*[F.col(c).alias(f"l_{c}") for c in later.columns])
    at = common.same(F.col("doc_id"), F.col("l_doc_id")) & (F.col("key") == F.col("l_key")) & (F.col("number") == F.col("l_number"))
    marked = common.cut(
        seeds.join(later, at, "left").select("doc_id", "key", "line", "stretches", F.col("l_key").isNotNull().alias("gone")), "line-marked"
    )
    numbers = common.cut(
        marked.filter("not gone")
        .select("doc_id", "key", "line", F.posexplode("stretches").alias("place", "digest"))
        .select("doc_id", "key", (F.col("line") + F.col("place")).alias("number"), "digest"),
        "line-stretches",
    )
    common.release(docs.sparkSession, seeds)
    lines = _repeats(thin, numbers, cutter.texts)
    common.release(docs.sparkSession, numbers)
    chunks = marked.filter("gone").select("doc_id", "key", F.explode(F.sequence("line", F.col("line") + F.size("stretches") - 1)).alias("number"))
    return _cleaned(docs, chunks.unionByName(lines), cutter.without)


def remove_repeated_chunks(docs: DataFrame, chunker: Chunker | None = None) -> DataFrame:
    """``docs`` with its texts cleaned, and ``n_lines, n_lines_removed``.

    A chunk of at least ``least_lines`` lines goes if the same bytes occur as a
    chunk before: earlier in the same text, or in a document with a smaller
    id (then text hash; null ids come last).  What is left is joined by line breaks; ``n_chars``,
    where there is one, follows the text.

    Null and empty texts have no lines and stay as they are.  Rows that agree
    in id and text get equal results: one that repeats only such a row stays.
    An empty table gives no rows; clashing new columns get leading
    underscores; columns other than text and n_chars are unchanged.
    """
    cutter, thin = chunker or Chunker(), _keyed(docs)
    numbers = common.cut(annotate.emit_rows(thin, "text", ["doc_id", "key"], cutter.digests, "number int, digest long"), "line-chunks")
    later = _repeats(thin, numbers, cutter.texts)
    common.release(docs.sparkSession, numbers)
    return _cleaned(docs, later, cutter.without)


def _cleaned(docs: DataFrame, gone: DataFrame, without: Callable) -> DataFrame:
    """``docs`` after ``without(texts, numbers)``, where ``gone`` has ``doc_id, key, number``."""
    gone = (
        gone.groupBy("doc_id", "key")
        .agg(F.collect_set("number").alias("gone"))
        .select(F.col("doc_id").alias("g_id"), F.col("key").alias("g_key"), "gone")
    )
    n_lines, n_gone = common.fresh(docs, "n_lines", "n_lines_removed")
    others = [c for c in docs.columns if c != "text"]
    joined = (
        docs.select(
            F.struct(*[F.col(annotate._quoted(c)) for c in others]).alias("row"),
            F.col("doc_id"),
            common.text_key(F.col("text")).alias("key"),
            F.col("text"),
        )
        .join(gone, common.same(F.col("doc_id"), F.col("g_id")) & (F.col("key") == F.col("g_key")), "left")
        .select("row", "text", "gone")
    )

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                left, n, out = without(part.column(1), part.column(2))
                arrays = [part.column(0), pa.array(left, pa.string()), pa.array(n, pa.int64()), pa.array(out, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "text", "n", "gone"])

    schema = f"row {joined.schema['row'].dataType.simpleString()}, text string, n long, gone long"
    cleaned = joined.mapInArrow(clean, schema)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col("gone") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars")).alias(c))
        else:
            columns.append(F.col(f"row.{annotate._quoted(c)}"))
    return cleaned.select(*columns, F.col("n").alias(n_lines), F.col("gone").alias(n_gone))
