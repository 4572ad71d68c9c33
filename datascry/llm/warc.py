"""WARC archives with revisit resolution.

Headers alone (id, payload digest, payload length) are shuffled to elect one
original per payload; revisit records are joined back to it.  Each task then
writes archives to the shared store, one gzip member a record, under names of
its own; the names are a Spark table, whose commit decides which files count, so
a task that runs twice leaves no record twice.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datascry.llm import common

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "page_id long, record_type string, record_id string, refers_to_id string, "
    "target_uri string, payload_digest string, payload_bytes long"
)


def _payload(html: str) -> Column:
    return F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")


def _seed(page: Column, digest: Column) -> Column:
    """What a record's id is made from, the same on every attempt of a task."""
    return F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("none")), digest)


def _record_id(page: Column, digest: Column) -> Column:
    h = F.md5(_seed(page, digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def resolve_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``pages`` with ``payload_digest, payload_bytes, record_type, refers_to, refers_to_url``.

    Of pages with equal payloads of at least ``min_bytes`` bytes the largest
    page_id is the response and the others revisit it; smaller ones are all
    responses.  Null html counts as empty.  Null page_ids count as smallest;
    rows that share the largest page_id are all responses.  Only ``page_id,
    url, html`` of the input are kept, so clashing extra columns do no harm.
    Rows come dealt and sorted by page_id and digest.
    """
    rows = pages.select("page_id", "url", "html").withColumns(
        {
            "payload_digest": F.sha1(_payload("html")),
            "payload_bytes": F.octet_length(F.coalesce("html", F.lit(""))).cast("long"),
            "page_key": F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        }
    )
    keys = ["page_key", "payload_digest"]
    heads = rows.select("page_id", "page_key", "url", "payload_digest", "payload_bytes").filter(F.col("payload_bytes") >= min_bytes)
    originals = (
        heads.groupBy("payload_digest", "payload_bytes")
        .agg(F.max(F.struct("page_id", "url")).alias("o"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1 and o.page_id is not null")
        .select("payload_digest", "payload_bytes", F.col("o.page_id").alias("refers_to"), F.col("o.url").alias("refers_to_url"))
    )
    # written, so that the headers of a very frequent payload can be dealt to many tasks
    originals = common.cut(originals, "warc-originals")
    revisits = (
        heads.join(originals, ["payload_digest", "payload_bytes"])
        .filter("page_id is null or page_id < refers_to")
        .select("page_key", "payload_digest", "refers_to", "refers_to_url")
        .distinct()
    )
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    joined = rows.repartition(*keys).join(revisits, keys, "left").withColumn("record_type", kind)
    return joined.sortWithinPartitions(*keys).drop("page_key")


#: Schemes that tasks can write to, and the names that pyarrow has for them.
STORES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def store_uri(spark: SparkSession, path: str) -> str:
    """``path`` as Spark's own file systems complete it, under the scheme that tasks know.

    A path without a scheme is one of the default store, which need not be the local disk.
    Raises ValueError, before any task runs, where tasks cannot open the store.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    scheme, _, rest = whole.partition(":")
    if scheme not in STORES:
        raise ValueError(f"tasks cannot write archives to {whole}: the store must be one of {', '.join(STORES)}")
    return f"{STORES[scheme]}:{rest}"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Archives:
    """Archive files that one task writes, one after the other."""

    def __init__(self, path: str, file_bytes: int, date: str):
        self.store, self.path = _store(path)  # as store_uri gives it
        self.file_bytes, self.date = file_bytes, date
        self.out = None
        self.done: list[tuple[str, int, int]] = []

    def add(self, record: bytes) -> None:
        member = gzip.compress(record, 6, mtime=0)
        if self.out is not None and self.size + len(member) > self.file_bytes:
            self.close()
        if self.out is None:
            self._begin()
        self.out.write(member)
        self.size += len(member)
        self.records += 1

    def _begin(self) -> None:
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        self.out = self.store.open_output_stream(f"{self.path}/{self.name}", compression=None)
        said = f"software: datascry{CRLF}format: WARC File Format 1.1{CRLF}".encode()
        lines = (
            "WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {self.date}", f"WARC-Filename: {self.name}",
            "Content-Type: application/warc-fields", f"Content-Length: {len(said)}",
        )
        member = gzip.compress(CRLF.join(lines).encode() + b"\r\n\r\n" + said + b"\r\n\r\n", 6, mtime=0)
        self.out.write(member)
        self.size, self.records = len(member), 0

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.records, self.size))
            self.out = None


def write_archives(
    pages: DataFrame, path: str, min_bytes: int = 1000, file_bytes: int = 32 << 20, date: str | None = None
) -> None:
    """Writes WARC/1.1 files ``*.warc.gz`` of at most ``file_bytes`` (or one record) each.

    Files follow the partitions of the join, so payloads are shuffled once.  Each
    begins with a warcinfo record; each record is a gzip member of its own.
    ``date`` (now by default) is that of the new headers.  Rows that agree in
    page_id and payload get record ids of their own; revisits refer to the first.
    The table ``_files`` beside them has ``file, records, bytes`` of each
    archive; what it does not name is left from tasks that ran again.
    """
    spark = pages.sparkSession
    date = date or spark.range(1).select(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")).first()[0]
    store = store_uri(spark, path)
    rows = resolve_revisits(pages, min_bytes)
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(CRLF + CRLF),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.coalesce("html", F.lit(""))))

    def line(name: str, value: Column) -> Column:
        """The header line, or nothing where its value is null."""
        return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit(""))

    def uri(c: str) -> Column:
        return F.regexp_replace(F.regexp_replace(c, "\r", "%0D"), "\n", "%0A")

    head = F.concat(
        line("WARC-Type", F.col("record_type")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to"), F.col("payload_digest")))),
        line("WARC-Refers-To-Target-URI", F.when(revisit, uri("refers_to_url"))),
        line("WARC-Refers-To-Date", F.when(revisit, F.lit(date))),
        line("X-Page-Id", F.col("page_id").cast("string")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(CRLF + CRLF),
    )
    common.small_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Archives(store, file_bytes, date)
        before, again = None, 0
        for batch in batches:
            for seed, top, said in zip(*batch.columns, strict=True):
                seed = seed.as_py()
                # rows that agree come one after the other
                before, again = seed, again + 1 if seed == before else 0
                number = uuid.UUID(hashlib.md5((f"{seed}|{again}" if again else seed).encode()).hexdigest())
                files.add(f"WARC/1.1{CRLF}WARC-Record-ID: <urn:uuid:{number}>{CRLF}{top.as_py()}{said.as_py()}{CRLF}{CRLF}".encode())
        files.close()
        if files.done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*files.done, strict=True)], ["file", "records", "bytes"])

    # the folder is made on the store before tasks write into it
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    records = rows.select(_seed(F.col("page_id"), F.col("payload_digest")).alias("seed"), head.alias("head"), block.alias("block"))
    records.mapInArrow(write, "file string, records long, bytes long").write.parquet(f"{path}/_files")


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """What each gzip member of ``data`` holds, one at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        one, out = zlib.decompressobj(31), []
        while not one.eof:
            if at >= len(view):
                raise ValueError("the last gzip member is cut off")
            fed = view[at : at + step]
            out.append(one.decompress(fed))
            at += len(fed) - len(one.unused_data)
        yield b"".join(out)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers (names in lower case) and block of each record of some bytes."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")[1:]
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head["content-length"])
        yield head, view[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.string() for x in RECORD_SCHEMA.split(", ")]
    for batch in batches:
        for content, file, listed in zip(*batch.columns, strict=True):
            out: list[list] = [[] for _ in names]
            for head, block in (x for one in members(content.as_py()) for x in parse_records(one)):
                kind = head["warc-type"]
                if kind not in ("response", "revisit"):
                    continue
                raw = bytes(block)
                payload = raw[raw.index(b"\r\n\r\n") + 4 :]
                page = head.get("x-page-id")
                whole = kind == "response"
                values = (
                    int(page) if page is not None else None,
                    kind,
                    head["warc-record-id"],
                    head.get("warc-refers-to"),
                    head.get("warc-target-uri"),
                    hashlib.sha1(payload).hexdigest() if whole else head["warc-payload-digest"].partition(":")[2],
                    len(payload) if whole else None,
                )
                for to, v in zip(out, values, strict=True):
                    to.append(v)
            if len(out[0]) != listed.as_py():
                raise ValueError(f"{file} holds {len(out[0])} records in place of {listed}")
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record: headers, and digest and length of each payload read.

    Raises ValueError where a file that ``_files`` lists is gone; a file that holds
    fewer or more records than listed there ends the job.  Files not listed are left alone.
    """
    listed = spark.read.schema("file string, records long, bytes long").parquet(f"{path}/_files")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    files = files.withColumn("file", F.element_at(F.split("path", "/"), -1))
    gone = [r["file"] for r in listed.join(files.select("file"), "file", "left_anti").limit(3).collect()]
    if gone:
        raise ValueError(f"archives are missing from {path}: {', '.join(gone)}")
    return files.join(listed, "file").select("content", "file", "records").mapInArrow(_rows, RECORD_SCHEMA)


def join_originals(records: DataFrame) -> DataFrame:
    """Gives each revisit the payload length and page_id of the response it names."""
    originals = (
        records.filter("record_type = 'response'")
        .select(
            F.col("record_id").alias("refers_to_id"),
            F.col("page_id").alias("refers_to"),
            F.col("payload_bytes").alias("original_bytes"),
        )
    )
    plain = records.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    revisits = records.filter("record_type = 'revisit'").join(originals, "refers_to_id", "left")
    revisits = revisits.withColumn("payload_bytes", F.col("original_bytes")).drop("original_bytes")
    return plain.unionByName(revisits)
