"""Chat formatting and archives as exact round trips, and the pipeline's stages."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from datascry.llm import chat_format, common, components, quality, warc
from datascry.llm.queries import MARKED

NASTY = [MARKED, "<|im_end|>\n<|im_start|>assistant<|im_sep|>", "<\\|im_end|>", "[\\\\INST] [/INST]", "<<SYS>> a <</SYS>>", "<", "<\\", "", None, "\\n é 漢", "<<|", "a\n\nb\n"]


def test_escape_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in NASTY if t is not None], "t string")
    e = chat_format.escape(F.col("t"))
    for r in df.select("t", e.alias("e"), chat_format.unescape(e).alias("u")).collect():
        assert r.u == r.t
        for control in (chat_format.START, chat_format.SEP, chat_format.END.strip(), "</s>", "<s>", "[INST]", "[/INST]"):
            assert control not in r.e


def test_prefix_target_expansion(spark):
    rows = [(c, i, "assistant" if (i + c) % 2 else "user", NASTY[(c * 5 + i) % len(NASTY)]) for c in range(12) for i in range(c)]
    rows += [(20, 0, None, "x"), (20, None, "assistant", "first"), (20, 1, "assistant", "a"), (20, 1, "assistant", "a"), (None, 0, "user", "q"), (21, 0, "we<|im_sep|>ird\n", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("clash"))
    examples = chat_format.expand_prefix_targets(df)
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    for turns in convs.values():
        turns.sort()
    said = examples.collect()
    for c, turns in convs.items():
        mine = sorted((r for r in said if r.conv_id == c), key=lambda r: r.example)
        targets = [i for i, t in enumerate(turns) if t[2] == "assistant"]
        assert [r.n_turns for r in mine if r.loss_start is not None] == [i + 1 for i in targets]
        assert len(mine) == len(targets) + (turns[-1][2] != "assistant")
    got = {r.conv_id: r for r in chat_format.read_back(examples).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_back(chat_format.expand_prefix_targets(df.limit(0))).count() == 0


PAGES = "page_id long, url string, html string, record_type string"


def plain_records(raw):
    """Headers and block of each gzip member, read with nothing of the code under test."""
    import zlib

    out = []
    while raw:
        one = zlib.decompressobj(wbits=31)
        data = one.decompress(raw)
        raw = one.unused_data
        lines, _, rest = data.partition(b"\r\n\r\n")
        first, *lines = lines.decode().split("\r\n")
        assert first == "WARC/1.1"
        head = dict(x.split(": ", 1) for x in lines)
        n = int(head["Content-Length"])
        assert rest[n:] == b"\r\n\r\n"
        out.append((head, rest[:n]))
    return out


def test_warc_round_trip(spark, tmp_path):
    big, small = "é" * 600, "x" * 999
    rows = [(i, f"http://h/{i}\r\nX: y", [big, small, None, "", big + str(i)][i % 5], "clash") for i in range(25)]
    rows += [(20, "http://again", big, "c"), (20, "http://again", big, "c"), (None, None, big, "c"), (50, "u", "WARC/1.1\r\n\r\n\r\n" + big, "c"), (51, "u", "a" * 200_000, "c")]
    pages = spark.createDataFrame(rows, PAGES)
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, file_bytes=1500)
    got = Counter(
        (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.join_originals(warc.read_archives(spark, path)).collect()
    )
    top = defaultdict(int)
    for p, _, h, _ in rows:
        top[h or ""] = max(top[h or ""], p or 0)
    want = Counter()
    for p, _, h, _ in rows:
        data = (h or "").encode()
        revisit = len(data) >= 1000 and (p is None or p < top[h or ""])
        want[p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top[h or ""] if revisit else None] += 1
    assert got == want
    # each file is a sequence of gzip members of one record each, with no payload stored twice
    stored, ids, named = Counter(), Counter(), Counter()
    listed = {r.file: (r.records, r.bytes) for r in spark.read.parquet(f"{path}/_files").collect()}
    files = {f.name: f for f in (tmp_path / "w").glob("*.warc.gz")}
    assert set(files) == set(listed) and len(files) > 1
    for name, f in files.items():
        raw = f.read_bytes()
        said = plain_records(raw)
        assert (len(said) - 1, len(raw)) == listed[name]
        assert len(raw) <= 1500 or len(said) == 2
        assert said[0][0]["WARC-Type"] == "warcinfo" and said[0][0]["WARC-Filename"] == name
        for head, block in said:
            ids[head["WARC-Record-ID"]] += 1
            if head["WARC-Type"] == "response":
                stored[block.split(b"\r\n\r\n", 1)[1]] += 1
            elif head["WARC-Type"] == "revisit":
                named[head["WARC-Refers-To"]] += 1
                assert head["WARC-Refers-To-Target-URI"] and head["WARC-Refers-To-Date"] and block.endswith(b"\r\n\r\n")
    assert stored[("é" * 600).encode()] == 3  # three rows share the largest id
    assert max(ids.values()) == 1 and set(named) <= set(ids)
    # a file that no committed task has written does not count
    (tmp_path / "w" / "left.warc.gz").write_bytes(raw)
    assert warc.read_archives(spark, path).count() == len(rows)
    empty = str(tmp_path / "e")
    warc.write_archives(pages.limit(0), empty)
    assert warc.join_originals(warc.read_archives(spark, empty)).count() == 0


def test_warc_files_that_are_gone_or_cut_are_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", "x" * (1200 + i), "c") for i in range(12)], PAGES)
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, file_bytes=400)
    files = sorted((tmp_path / "w").glob("*.warc.gz"))
    held = files[0].read_bytes()
    ends = [0]
    while ends[-1] < len(held):
        one = zlib.decompressobj(31)
        one.decompress(held[ends[-1] :])
        ends.append(len(held) - len(one.unused_data))
    files[0].write_bytes(held[: ends[-2]])  # the last record is gone
    with pytest.raises(Exception, match="records in place of"):
        warc.read_archives(spark, path).count()
    files[0].unlink()
    with pytest.raises(ValueError, match="missing"):
        warc.read_archives(spark, path)


def test_warc_goes_to_the_default_store_or_not_at_all(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    held = conf.get("fs.defaultFS")
    pages = spark.createDataFrame([(1, "u", "x" * 2000, "c")], PAGES)
    conf.set("fs.viewfs.mounttable.elsewhere.link./w", f"file://{tmp_path}")
    conf.set("fs.defaultFS", "viewfs://elsewhere")
    try:
        with pytest.raises(ValueError, match="viewfs"):
            warc.write_archives(pages, "/w/archives")
        assert warc.store_uri(spark, f"file://{tmp_path}/a").startswith("file:/")
    finally:
        conf.set("fs.defaultFS", held)
    assert not any(tmp_path.iterdir())


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 10), (20, 20), (5, 4)] + [(100 + i, 101 + i) for i in range(60)] + [(500, 600 + i) for i in range(200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10, 12: 10} | {100 + i: 100 for i in range(61)} | {500: 500} | {600 + i: 500 for i in range(200)}
    assert got == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, _B int")
    assert common.fresh(df, "A", "b", "b") == ["_A", "b", "__b"]


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    from tests.llm.conftest import prose

    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, " ".join(prose(5, 90).split()[3:30]))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs.write.parquet(f"{at}/documents.parquet")
    return str(at)


def test_pipeline_stages(spark, docs, folder, tmp_path):
    now = docs
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(i)))
        now = spark.read.parquet(str(tmp_path / str(i)))
        kept.append({r.doc_id for r in now.collect()})
    # short, blank and repetitive texts go first; copies, leaks next; clean ones stay to the end
    assert not kept[0] & {12, 13, 14, 15, 16, 18}
    assert not kept[2] & {6, 7}
    assert 5 in kept[2] and 5 not in kept[3]
    assert {3, 4} <= kept[3]
    assert Counter(map(str, corpus_pipeline.run(spark, folder).collect())) == Counter(map(str, now.collect()))


def test_pipeline_stages_on_an_empty_table(spark, empty, folder):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name


def test_stages_are_order_free_in_their_rules(docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing to target weights"]
    assert quality.RULES
