"""From files to tables: delimiters, headers, ragged rows, workbooks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from datascry.functions.values import is_blank

MOST_COLUMNS = 200
MOST_FIELD_CHARS = 1_000_000
MOST_WORKBOOK_XML = 100 << 20
MOST_WORKBOOK_ENTRIES = 10_000
DELIMITERS = (",", "\t", ";", "|")


class TableError(ValueError):
    """The input is no table, or goes beyond a limit."""


def sniff_delimiter(text: str) -> str:
    """The most frequent delimiter of the first line outside quotes; ties keep
    the listed order, none gives a comma."""
    line = text.removeprefix("﻿").split("\n", 1)[0]
    unquoted = "".join(line.split('"')[::2])
    return max(DELIMITERS, key=unquoted.count) if any(d in unquoted for d in DELIMITERS) else ","


def unique_headers(names: Sequence[str | None]) -> list[str]:
    """Trimmed names; blank ones by position, repeated ones numbered from 2."""
    out: list[str] = []
    for i, name in enumerate(names):
        base = (name or "").strip() or f"Column {i + 1}"
        name, n = base, 2
        while name in out:
            name, n = f"{base} ({n})", n + 1
        out.append(name)
    return out


def find_header(rows: Sequence[Sequence[str | None]]) -> int:
    """Of the first eight rows, the one that looks most like a header: filled
    cells, half as much again for text, less half a point a row."""
    head = [[(c or "").strip() for c in r] for r in rows[:8]]
    widest = max([sum(map(bool, r)) for r in head] + [1])

    def wordy(cell: str) -> bool:
        bare = "".join(c for c in cell if c not in "$,%" and not c.isspace())
        try:
            float(bare or "0")
        except ValueError:
            return True
        return False

    scores = {}
    for i, r in enumerate(head):
        filled = [c for c in r if c]
        if len(filled) >= widest * 0.6:
            scores[i] = len(filled) + 1.5 * sum(map(wordy, filled)) - 0.5 * i
    return max(scores, key=lambda i: scores[i], default=0)


def to_table(cells: DataFrame, most_columns: int = MOST_COLUMNS) -> DataFrame:
    """A table of text columns and ``_row`` from ``_row, cells array<string>``.

    Rows up to the header go, then rows and columns that are blank throughout.
    """
    filled = cells.filter(F.exists("cells", lambda c: ~is_blank(c)))
    head = filled.orderBy("_row").limit(8).collect()
    if not head:
        raise TableError("no tabular data")
    width = filled.agg(F.max(F.size("cells"))).first()[0]
    if width > most_columns:
        raise TableError(f"more than {most_columns} columns")
    at = find_header([r["cells"] for r in head])
    names = unique_headers([(list(head[at]["cells"]) + [None] * width)[i] for i in range(width)])
    body = filled.filter(F.col("_row") > head[at]["_row"])
    table = body.select("_row", *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])
    kept = table.agg(*[F.max(~is_blank(F.col(f"`{n}`"))).alias(f"c{i}") for i, n in enumerate(names)]).first()
    used = [n for i, n in enumerate(names) if kept[i]]
    if not used:
        raise TableError("no tabular data")
    return table.select("_row", *[F.col(f"`{n}`") for n in used])


def parse_delimited(text: str, sep: str, most_field: int = MOST_FIELD_CHARS) -> list[list[str]]:
    """Cells of delimited text.  A quote opens and closes anywhere in a field and is
    doubled to stand for itself; a carriage return outside quotes is dropped."""
    token = re.compile(f'"(?:[^"]|"")*(?:"|$)|{re.escape(sep)}|\r|\n|[^"{re.escape(sep)}\r\n]+')
    rows: list[list[str]] = []
    row: list[str] = []
    field: list[str] = []
    size = 0
    for m in token.finditer(text):
        said = m.group()
        if said in (sep, "\n"):
            row.append("".join(field))
            field, size = [], 0
            if said == "\n":
                rows.append(row)
                row = []
        elif said != "\r":
            if said[0] == '"':
                body = said[1:-1] if len(said) > 1 and said.endswith('"') else said[1:]
                said = body.replace('""', '"')
            field.append(said)
            size += len(said)
            if size > most_field:
                raise TableError(f"a cell has more than {most_field:,} characters")
    if field or row:
        rows.append([*row, "".join(field)])
    return rows


def _split_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part of a file that a task reads: its quotes, and whether any of its lines
    begins a record if the part begins outside quotes, or inside."""
    at, quotes, even, odd = None, 0, False, False

    def out() -> pa.RecordBatch:
        columns = zip((*at, quotes, even, odd), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in columns], names=["file", "begin", "quotes", "even", "odd"])

    for lines, file, begin in _by_split(batches):
        if at != (file, begin):
            if at:
                yield out()
            at, quotes, even, odd = (file, begin), 0, False, False
        n = np.asarray(pc.count_substring(lines, '"'))
        inside = (quotes + np.cumsum(n) - n) & 1
        even, odd, quotes = even or bool((inside == 0).any()), odd or bool((inside == 1).any()), quotes + int(n.sum())
    if at:
        yield out()


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The lines of each batch with what the other columns say of their part of a file."""
    for batch in batches:
        lo, begins, files = 0, batch.column(2), batch.column(1)
        change = [i for i in range(1, batch.num_rows) if begins[i] != begins[i - 1] or files[i] != files[i - 1]] if pc.count_distinct(begins).as_py() + pc.count_distinct(files).as_py() > 2 else []
        for hi in [*change, batch.num_rows]:
            if hi > lo:
                yield batch.column(0)[lo:hi], *[batch.column(c)[lo].as_py() for c in range(1, batch.num_columns)]
            lo = hi


def _records(sep: str, whole: bool):
    """Of each part of a file, the records that begin and end in it (``whole``) as cells, or
    else the pieces of those that reach over its ends, with the number of the part they began in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, first, part, came_from, odd, seen = None, [], 0, 0, None, 0, 0
        rows: list[tuple] = []

        def close(end: bool) -> None:
            """The lines held are a record, or a piece of one."""
            nonlocal held
            if held and came_from is not None:  # it began in an earlier part
                if not whole:
                    rows.append(((came_from << 33), part, "\n".join(held)))
            elif held and end and odd:  # it goes on in a later one
                if not whole:
                    rows.append(((part << 33), part, f"{first}\n" + "\n".join(held)))
            elif held and whole:
                said = "\n".join(held)
                cells = parse_delimited(said, sep)[0] if '"' in said else said.replace("\r", "").split(sep)
                rows.append(((part << 33) + first, cells))
            held = []

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.list_(pa.string())) if whole else (pa.int64(), pa.int64(), pa.string())
            columns = list(zip(*rows)) if rows else [[] for _ in kinds]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["_row", "cells"] if whole else ["record", "piece", "said"])

        for lines, file, begin, state, number, origin in _by_split(batches):
            if state is None:
                raise TableError("the files have changed while they were read")
            if at != (file, begin):
                close(True)
                at, odd, part, seen = (file, begin), state, number, 0
                came_from = origin if state else None
            n = np.asarray(pc.count_substring(lines, '"'))
            inside = (odd + np.cumsum(n) - n) & 1
            for line, continued in zip(lines.to_pylist(), inside.tolist()):
                if not continued:
                    if seen:
                        close(False)
                        came_from = None
                    first = seen
                if whole or came_from is not None or continued or len(held) == 0:
                    held.append(line)
                seen += 1
            odd = (odd + int(n.sum())) & 1
            if sum(map(len, held)) > 2 * MOST_FIELD_CHARS and odd:
                raise TableError(f"a cell has more than {MOST_FIELD_CHARS:,} characters")
            if len(rows) > 5000:
                yield out()
                rows.clear()
        close(True)
        yield out()

    return run


def _joined(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells = [], []
            for record, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first, _, said = pieces[0].partition("\n")
                rows.append(record + int(first))
                cells.append(parse_delimited("\n".join([said, *pieces[1:]]), sep)[0])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(cells, pa.list_(pa.string()))], names=["_row", "cells"])

    return run


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, most_columns: int = MOST_COLUMNS) -> DataFrame:
    """Delimited text as a table of text columns and ``_row``, which rises in the order of
    files and lines.  Quotes are read as by :func:`parse_delimited`; ragged rows are filled up.

    Files are split however large they are.  A first pass counts the quotes of each
    split; their running parity tells whether a split begins inside quotes, so the
    second parses each by itself.  Records that reach over splits are put together of
    their pieces, at most two for each split.  Without any quotes there is no Python.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))
    if sep is None:
        first = lines.select("value").limit(1).collect()
        sep = sniff_delimiter(first[0][0] if first else "")
    splits = lines.mapInArrow(_split_states, "file string, begin long, quotes long, even boolean, odd boolean")
    # one row for each split of the files: a few bytes for each 128 MB
    known = spark.createDataFrame(splits.collect(), splits.schema)
    if not known.filter("quotes > 0").isEmpty():
        so_far = W.partitionBy("file").orderBy("begin").rowsBetween(W.unboundedPreceding, -1)
        numbered = known.withColumns(
            {
                "state": (F.coalesce(F.sum("quotes").over(so_far), F.lit(0)) % 2).cast("int"),
                "number": (F.row_number().over(W.partitionBy(F.lit(0)).orderBy("file", "begin")) - 1).cast("long"),
            }
        )
        begins = F.when(F.when(F.col("state") == 1, F.col("odd")).otherwise(F.col("even")), F.col("number"))
        states = numbered.withColumn("origin", F.last(begins, True).over(so_far)).select("file", "begin", "state", "number", "origin")
        met = lines.join(F.broadcast(states), ["file", "begin"], "left").select("value", "file", "begin", "state", "number", "origin")
        inner = met.mapInArrow(_records(sep, True), "_row long, cells array<string>")
        pieces = met.mapInArrow(_records(sep, False), "record long, piece long, said string")
        over = pieces.groupBy("record").agg(F.transform(F.sort_array(F.collect_list(F.struct("piece", "said"))), lambda p: p["said"]).alias("pieces"))
        cells = inner.unionByName(over.mapInArrow(_joined(sep), "_row long, cells array<string>"))
    else:
        bare = F.regexp_replace("value", "\r", "")
        cells = lines.select(F.monotonically_increasing_id().alias("_row"), F.split(bare, re.escape(sep)).alias("cells"))
    bom = F.transform("cells", lambda c, i: F.when(i == 0, F.regexp_replace(c, "^\ufeff", "")).otherwise(c))
    return to_table(cells.withColumn("cells", bom), most_columns)


def read_text_block(spark: SparkSession, text: str, sep: str | None = None) -> DataFrame:
    """The same for text in memory, such as a pasted block."""
    text = text.removeprefix("\ufeff")
    rows = parse_delimited(text, sep or sniff_delimiter(text))
    if not rows:
        raise TableError("no tabular data")
    return to_table(spark.createDataFrame(list(enumerate(rows)), "_row long, cells array<string>"))


# ------------------------------------------------------------ workbooks

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
#: Number formats of dates and times.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def column_index(reference: str) -> int:
    """Zero-based column of a cell reference such as ``AB12``."""
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return max(0, n - 1)


def serial_day(serial: float) -> str:
    """ISO day of a spreadsheet's day number."""
    return (datetime(1899, 12, 30) + timedelta(milliseconds=round(serial * 86_400_000))).strftime("%Y-%m-%d")


def _is_date_code(code: str) -> bool:
    bare, depth = [], 0
    for ch in code:
        depth += ch == "["
        if not depth:
            bare.append(ch.lower())
        depth -= ch == "]"
    return any(c in "dmy" for c in code.lower()) and not any(c in "#0" for c in bare)


def _part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def _first_sheet(archive: zipfile.ZipFile) -> str:
    """Path of the first sheet in workbook order, visible ones before hidden ones."""
    book, links = _part(archive, "xl/workbook.xml"), _part(archive, "xl/_rels/workbook.xml.rels")
    targets = {x.get("Id"): x.get("Target") for x in links.iter(_PACKAGE + "Relationship")} if links is not None else {}
    sheets = list(book.iter(_MAIN + "sheet")) if book is not None else []
    for sheet in sorted(sheets, key=lambda s: s.get("state") in ("hidden", "veryHidden")):
        target = targets.get(sheet.get(_LINK))
        if not target:
            continue
        at: list[str] = [] if target.startswith("/") else ["xl"]
        for step in target.strip("/").split("/"):
            if step == "..":
                at = at[:-1]
            elif step not in ("", "."):
                at.append(step)
        if "/".join(at) in archive.namelist():
            return "/".join(at)
    raise TableError("no worksheet found")


def workbook_rows(data: bytes) -> Iterator[list[str]]:
    """Rows of the first sheet as text: shared and inline strings, booleans as
    TRUE and FALSE, dates as ISO days, numbers as they are stored."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    entries = archive.infolist()
    if len(entries) > MOST_WORKBOOK_ENTRIES or sum(e.file_size for e in entries if e.filename.endswith((".xml", ".rels"))) > MOST_WORKBOOK_XML:
        raise TableError("the workbook is too large")
    shared_part = _part(archive, "xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in si.iter(_MAIN + "t")) for si in shared_part.iter(_MAIN + "si")] if shared_part is not None else []
    styles, dates = _part(archive, "xl/styles.xml"), set()
    if styles is not None:
        custom = {f.get("numFmtId") for f in styles.iter(_MAIN + "numFmt") if _is_date_code(f.get("formatCode") or "")}
        forms = styles.find(_MAIN + "cellXfs")
        for i, form in enumerate(forms if forms is not None else ()):
            if form.get("numFmtId") in custom or int(form.get("numFmtId") or 0) in DATE_FORMATS:
                dates.add(i)
    for row in _part(archive, _first_sheet(archive)).iter(_MAIN + "row"):
        cells: dict[int, str] = {}
        for place, cell in enumerate(row.iter(_MAIN + "c")):
            kind, value = cell.get("t"), cell.find(_MAIN + "v")
            raw = value.text if value is not None else None
            if kind == "inlineStr":
                said = "".join(t.text or "" for t in cell.iter(_MAIN + "t"))
            elif raw is None:
                said = ""
            elif kind == "s":
                said = shared[int(raw)] if int(raw) < len(shared) else ""
            elif kind == "b":
                said = "TRUE" if raw == "1" else "FALSE"
            else:
                said = raw
                if kind not in ("str", "e") and int(cell.get("s") or -1) in dates and 20 < float(raw) < 2958466:
                    said = serial_day(float(raw))
            at = column_index(cell.get("r")) if cell.get("r") else place
            if at >= MOST_COLUMNS:
                raise TableError(f"more than {MOST_COLUMNS} columns")
            cells[at] = said
        yield [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]


def _workbook_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows = list(workbook_rows(content.as_py()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["_row", "cells"]
            )


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first visible sheet of an xlsx or xlsm file as a table."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return to_table(files.mapInArrow(_workbook_batches, "_row long, cells array<string>"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By extension: Parquet, workbook, else delimited text."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "xls":
        raise TableError("legacy .xls is not supported: save it as .xlsx or .csv")
    if kind == "parquet":
        return spark.read.parquet(path)
    return read_workbook(spark, path) if kind in ("xlsx", "xlsm") else read_delimited(spark, path)


def with_row_numbers(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the 1-based number of each row in the order of its partitions, as ``name``.

    Nothing is shuffled: partitions are counted first (a row for each), and a row's place in
    its own is added to the rows of all before.  ``df`` must read alike each time.
    """
    placed = df.drop(name).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("_id", 33)
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for p in sorted(counts):
        before.append((p, total))
        total += counts[p]
    if not before:
        return placed.withColumnRenamed("_id", name)
    offsets = df.sparkSession.createDataFrame(before, "_part long, _before long")
    met = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return met.select(*[F.col(f"`{c}`") for c in df.columns if c != name], (F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))


def preview(df: DataFrame, rows: int = 8) -> DataFrame:
    return (df.orderBy("_row") if "_row" in df.columns else df).limit(rows)
