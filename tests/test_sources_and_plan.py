"""Readers, headers, types, the scan, and whole reports."""

import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from datascry.operators import explore, relations, series
from datascry.plans import queries
from datascry.plans.analyse import analyse
from datascry.plans.export import to_html, to_json, write_frames
from datascry.sources import infer, samples, tables


def test_headers():
    assert tables.unique_headers(["Name", "Name", "Name (2)", "Name"]) == ["Name", "Name (2)", "Name (2) (2)", "Name (3)"]
    assert tables.unique_headers([None, " a ", ""]) == ["Column 1", "a", "Column 3"]
    assert tables.find_header([["Report"], ["made 2024"], ["Region", "Segment", "Revenue"], ["N", "S", "5"]]) == 2
    assert tables.sniff_delimiter('a;"b,c,d";e\nx,y') == ";"
    assert tables.sniff_delimiter("﻿a\tb") == "\t"
    assert tables.sniff_delimiter("abc") == ","


def test_delimited(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('Report\n\nRegion,"Se""g",Rev,Empty\nN,"a\nb",5\n\n,,\nS,c,6,\nT\n', encoding="utf-8")
    got = tables.read_table(spark, str(path))
    assert got.columns == ["_row", "Region", 'Se"g', "Rev"]
    assert [tuple(r)[1:] for r in got.orderBy("_row").collect()] == [("N", "a\nb", "5"), ("S", "c", "6"), ("T", "", "")]
    block = tables.read_text_block(spark, "a|b\r\n1|2\r\n")
    assert [tuple(r) for r in block.drop("_row").collect()] == [("1", "2")]
    with pytest.raises(tables.TableError):
        tables.read_text_block(spark, " \n ")
    with pytest.raises(tables.TableError):
        tables.read_table(spark, "old.xls")
    with pytest.raises(tables.TableError):
        tables.read_delimited(spark, str(path), most_columns=2)


def workbook(path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="H" state="hidden" r:id="r1"/><sheet name="V" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet9.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>City</t></si><si><r><t>Sao </t></r><r><t>Paulo</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet9.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Day</t></is></c><c r="D1" t="inlineStr"><is><t>Ok</t></is></c></row>'
                   '<row><c r="A2" t="s"><v>1</v></c><c r="B2" s="1"><v>45351</v></c><c r="D2" t="b"><v>1</v></c></row></sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    path = tmp_path / "b.xlsx"
    workbook(path)
    got = tables.read_table(spark, str(path))
    assert [r.asDict() for r in got.drop("_row").collect()] == [{"City": "Sao Paulo", "Day": "2024-02-29", "Ok": "TRUE"}]
    assert tables.column_index("AA12") == 26


def test_types(spark):
    rows = [(f"c{i}", str(i % 9), f"0{i % 4}", str(2000 + i % 5), f"{i * 7}", f"${i},000.50", f"{i}%", "yes" if i % 2 else "no", f"2024-01-{i % 28 + 1:02d}", f"note {i} x{i * 3}", " ") for i in range(60)]
    names = ["customer_id", "account_code", "postal_code", "year", "measurement", "Total", "Rate", "Flag", "When", "Remark", "Nothing"]
    got = infer.infer_types(spark.createDataFrame(rows, names))
    assert got == {"customer_id": "id", "account_code": "category", "postal_code": "category", "year": "category", "measurement": "number", "Total": "currency",
                   "Rate": "percent", "Flag": "boolean", "When": "date", "Remark": "category", "Nothing": "text"}
    assert infer.infer_types(spark.createDataFrame(rows, names), types={"Remark": "text"})["Remark"] == "text"


@pytest.mark.parametrize(
    ("headers", "cell", "blocked"),
    [(["Philosophy", "Grade"], "Sophia from Memphis", False), (["patient_name"], "x", True), (["Note"], "ICD-10 code", True), (["diagnosis", "hospital"], "x", True),
     (["student", "diagnosis", "hospital"], "x", False), (["diagnosis"], "sample data", False), (["MRN"], "", True)],
)
def test_health_scan(spark, headers, cell, blocked):
    df = spark.createDataFrame([tuple([cell] * len(headers))], headers)
    assert infer.health_scan(df)["blocked"] is blocked


def sales(spark, n=600, signal=True):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        tier = rng.choice(["Bronze", "Silver", "Gold"])
        units = rng.randint(1, 40)
        lift = {"Bronze": 1.0, "Silver": 1.6, "Gold": 2.6}[tier] if signal else 1.0
        rows.append((f"2024-{i % 12 + 1:02d}-{i % 28 + 1:02d}", tier, rng.choice(["N", "S", "E", "W"]), units, round(lift * (units * 10 + rng.random() * 50), 2) if signal else round(rng.random() * 500, 2)))
    return spark.createDataFrame(rows, "Date string, Tier string, Region string, Units long, Revenue double")


def test_report_finds_planted_signal(spark, tmp_path):
    rep = analyse(sales(spark))
    assert rep.metric == "Revenue" and rep.types["Date"] == "date"
    assert any(d["driver"] == "Tier" and d["metric"] == "Revenue" for d in rep.lists["drivers"])
    assert rep.lists["correlations"][0]["a"] == "Units"
    kinds = {f["kind"] for f in rep.findings}
    assert {"driver", "correlation", "metric", "composition"} <= kinds and "nosignal" not in kinds
    scores = [f["score"] for f in rep.findings]
    assert scores == sorted(scores, reverse=True)
    assert len(rep.summary) >= 60 and rep.actions
    assert "<h1>" in to_html(rep, sales(spark)) and '"metric": "Revenue"' in to_json(rep)
    write_frames(rep, str(tmp_path / "frames"))
    assert spark.read.parquet(str(tmp_path / "frames" / "drivers")).count()


def test_workshop_sample_finds_what_is_planted(spark):
    rep = analyse(samples.workshop(spark).coalesce(1), row="Job ID")
    assert rep.rows == 900 and len(rep.types) == 17 and rep.metric == "Job Revenue" and rep.types["Received"] == "date"
    assert len(rep.findings) >= 15 and len(rep.lists["drivers"]) >= 6
    on_hours = [d["driver"] for d in rep.lists["drivers"] if d["metric"] == "Labour Hours" and "(quintile)" not in d["driver"]]
    assert set(on_hours[:2]) == {"Motor", "Bike Kind"}
    found = {frozenset((r["a"], r["b"])): r["r"] for r in rep.lists["correlations"]}
    assert found[frozenset(("Wear", "Kilometres Ridden"))] > 0.8 and found[frozenset(("Satisfaction", "Waiting Days"))] < -0.8
    assert {frozenset((r["a"], r["b"])) for r in rep.lists["associations"]} >= {frozenset(("Bike Kind", "Shop")), frozenset(("Bike Kind", "Motor"))}
    assert not any({"Mechanic", "Booked Online"} & {d["driver"]} for d in rep.lists["drivers"])
    odd = {r["row"] for r in rep.lists["outliers"] if r["column"] == "Job Revenue"}
    assert {f"J-{i * 7 + 11:05d}" for i in range(90, 900, 181)} <= odd
    strip = {c["label"]: c["value"] for c in rep.strip}
    assert strip["Rows"] == "900" and {"Data quality", "Top association", "Outliers", "Median Job Revenue"} <= set(strip)
    matrix = {(r["a"], r["b"]): r["r"] for r in rep.lists["corr_matrix"]}
    assert len(matrix) == 8 * 8 and all(matrix[b, a] == r for (a, b), r in matrix.items())
    assert {r["side"] for r in rep.lists["hot_and_cold"]} == {"above", "below"}
    assert any(k.startswith("composition:") for k in rep.lists)
    rep.source.unpersist()


def test_hires_sample_rises_and_has_weekends(spark):
    rep = analyse(samples.hires(spark).coalesce(1))
    assert rep.metric == "Income" and rep.date == "Day" and rep.rows == 520
    kinds = {f["kind"]: f["title"] for f in rep.findings}
    assert "rising" in kinds["trend"] and "seasonality" in kinds
    assert any(d["driver"] == "Weather" and d["metric"] == "Income" for d in rep.lists["drivers"])
    assert all(isinstance(r["row"], str) and 1 <= int(r["row"]) <= 520 for r in rep.lists["outliers"] if r["row"] is not None)
    rep.source.unpersist()


@pytest.mark.parametrize("rows", [0, 1, 6, 30, 137, 933])
def test_reports_of_few_rows(spark, rows):
    df = spark.range(rows).select((F.col("id") * F.col("id")).cast("double").alias("Cost"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("Item"), (F.col("id") % 46).cast("double").alias("Units"))
    rep = analyse(df)
    assert rep.rows == rows and len(rep.summary) >= 60 and rep.actions
    if rows > 20:
        cost = next(p for p in rep.profiles if p["column"] == "Cost")
        assert [cost[k] for k in ("p05", "q1", "median", "q3", "p95")] == pytest.approx(np.quantile([float(i * i) for i in range(rows)], (0.05, 0.25, 0.5, 0.75, 0.95)).tolist(), abs=1e-9)
    rep.source.unpersist()


def test_rows_are_numbered_from_one_over_partitions(spark):
    df = spark.range(0, 1000, 1, 4).filter("id % 3 <> 0").withColumn("x", F.when(F.col("id") == 998, 1e6).otherwise(F.col("id") % 10))
    got = tables.with_row_numbers(df, "row")
    assert [r["row"] for r in got.orderBy("id").collect()] == list(range(1, got.count() + 1))
    assert relations.outliers(got, ["x"], "row").first()["row"] == got.filter("id = 998").first()["row"] == 666
    assert tables.with_row_numbers(df.limit(0), "row").count() == 0
    assert tables.with_row_numbers(got, "row").columns == got.columns


def test_report_of_messy_and_single_columns(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["Web", "web", "Shop"]), f"${rng.random() * 90:.2f}" if i % 9 else "", str(i % 7) if i % 5 else None, "same") for i in range(250)]
    rep = analyse(spark.createDataFrame(rows + rows[:12], "Channel string, Amount string, Qty string, Flag string"))
    issues = {(r["column"], r["issue"]) for r in rep.lists["issues"]}
    assert {("(rows)", "duplicate rows"), ("Channel", "case variants"), ("Flag", "constant")} <= issues
    assert rep.types["Amount"] == "currency" and rep.findings
    one = analyse(spark.createDataFrame([(math.exp(rng.random() * 6),) for _ in range(200)], "Value double"))
    assert one.metric == "Value" and any(f["kind"] == "distribution" for f in one.findings)


def test_booleans_are_counted_without_case(spark):
    df = spark.createDataFrame([(x,) for x in ["Yes", "yes", "No", "no", "YES"] * 9], "Flag string")
    assert infer.infer_types(df) == {"Flag": "boolean"}


def test_delimited_text_with_odd_quotes(spark):
    text = 'name,note\r\na"b,""c",x\r\n"two\r\nlines",y' + "z" * 200_000 + "\n"
    assert tables.parse_delimited(text, ",")[1:] == [['ab,"c', "x"], ["two\r\nlines", "y" + "z" * 200_000]]
    with pytest.raises(tables.TableError):
        tables.parse_delimited("x" * 1_000_001, ",")
    assert tables.read_text_block(spark, text).count() == 2


@pytest.mark.parametrize("split", [60, 700, 1 << 20])
def test_split_files_read_as_pasted_text_does(spark, tmp_path, split):
    """Quotes anywhere, breaks in quotes, records over many splits: one parser, however files are split."""
    rng = random.Random(split)
    cells = ["", "a", '"x,y"', '"two\nlines"', 'mid"d,le"q', '"say ""hi"""', '"\n\n\n"', "é中", '"cr\r\nin"', '"' + "long\n" * 30 + '"', "0", '""', '"","']
    text = "one,two,three\r\n" + "".join(",".join(rng.choice(cells) for _ in range(3)) + rng.choice(["\n", "\r\n"]) for _ in range(25)) + 'last,"open\nend,'
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode())
    want = [[c or "" for c in r[1:]] for r in tables.read_text_block(spark, text, ",").orderBy("_row").collect()]
    held = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = tables.read_table(spark, str(path))
        got = [list(r[1:]) for r in df.orderBy("_row").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held[0])
        spark.conf.set("spark.sql.files.openCostInBytes", held[1])
    assert got == want


def test_files_with_and_without_quotes(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("k,v\r\n1,\"x\ny\"\r\n2,b\r\n")
    (folder / "b.csv").write_text('3,"c"\n4,d\n')
    assert [tuple(r) for r in tables.read_table(spark, str(folder)).orderBy("_row").select("k", "v").collect()] == [("1", "x\ny"), ("2", "b"), ("3", "c"), ("4", "d")]
    (tmp_path / "plain.csv").write_text("\ufeffa;b\r\n1;2\r\n3;4")
    assert [tuple(r) for r in tables.read_table(spark, str(tmp_path / "plain.csv")).select("a", "b").collect()] == [("1", "2"), ("3", "4")]
    (tmp_path / "stray.csv").write_text('a,b\n1,"never closed\n' + "z" * 2_100_000)
    with pytest.raises(Exception, match="characters"):
        tables.read_table(spark, str(tmp_path / "stray.csv")).count()


def test_bands_use_up_no_place_where_there_are_none(spark):
    df = spark.range(60).select(F.lit(1.0).alias("flat"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    got = relations.with_quintiles(df, ["flat", "x", "y"], 1)
    assert got.columns == ["flat", "x", "y", "x (quintile)"]


def test_report_without_signal_or_numbers(spark):
    rng = random.Random(2)
    plain = spark.createDataFrame([(rng.choice("abcd"), rng.choice("xyz")) for _ in range(300)], "Department string, Region string")
    rep = analyse(plain)
    assert rep.metric is None and rep.findings and rep.actions
    tiny = analyse(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "Item string, Cost double"))
    assert len(tiny.summary) >= 60


def test_entry_without_the_corpus_subpackage(tmp_path):
    """What stays once the corpus folders are deleted still imports."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "datascry", tmp_path / "datascry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_no_module_outside_imports_the_corpus_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "datascry"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "datascry.llm" not in path.read_text(), path


def test_every_cell_counts_in_types(spark):
    df = spark.range(40).select(F.lit(None).cast("string").alias("a"), F.col("id").cast("string").alias("value"))
    assert infer.infer_types(df) == {"a": "text", "value": "currency"}


def test_rows_with_a_key_are_not_grouped_for_repeats(spark, monkeypatch):
    from datascry.operators import profile

    keyed = spark.range(60).select(F.col("id").alias("key"), (F.col("id") % 7).cast("double").alias("v"))
    assert analyse(keyed.union(keyed.limit(3))).quality["duplicates"] == 3

    def grouped(*args):
        raise AssertionError("rows are grouped")

    monkeypatch.setattr(profile, "duplicate_rows", grouped)
    report = analyse(keyed)
    assert report.quality["duplicates"] == 0
    report.source.unpersist()


def test_native_columns_are_typed_without_patterns(spark, monkeypatch):
    df = spark.range(60).select("id", F.lit(2.5).alias("price"), F.current_timestamp().alias("at"), (F.col("id") % 2).alias("bit"), (F.col("id") % 2 == 0).alias("truth"), F.lit(" Yes ").alias("said"))
    assert infer.infer_types(df) == {"id": "id", "price": "currency", "at": "date", "bit": "boolean", "truth": "boolean", "said": "boolean"}

    def never(c):
        raise AssertionError("native cells need no text")

    monkeypatch.setattr(infer.V, "trimmed", never)
    assert infer.infer_types(df.select("id", "price", "at")) == {"id": "id", "price": "currency", "at": "date"}


def test_report_queries_work_out_what_they_show(spark, tmp_path, monkeypatch):
    key = F.col("id")
    spark.range(360).select(
        key.alias("o_orderkey"), (key % 40).alias("o_custkey"), F.element_at(F.array(*map(F.lit, "FOP")), (key % 3 + 1).cast("int")).alias("o_orderstatus"),
        F.round(F.exp(key / 40), 2).alias("o_totalprice"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, int(id % 90))").alias("o_orderdate"),
        F.concat((key % 5 + 1).cast("string"), F.lit("-P")).alias("o_orderpriority"),
    ).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(40).select(key.alias("c_custkey"), F.concat(F.lit("S"), (key % 4).cast("string")).alias("c_mktsegment")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    sf = str(tmp_path)
    whole = analyse(queries._sales(spark, sf), row="o_orderkey")
    whole.source.unpersist()

    def unseen(*args, **named):
        raise AssertionError("no query so far shows this")

    for module, name in ((relations, "with_ranks"), (relations, "medians"), (explore, "decile_share"), (series, "month_breakdown"), (relations, "corr_matrix")):
        monkeypatch.setattr(module, name, unseen)
    strip = [r.asDict() for r in queries.kpi_strip(spark, sf).collect()]
    assert strip == [{"place": i} | c for i, c in enumerate(whole.strip, 1)] and len(strip) == 7
    assert queries.summary(spark, sf).first().summary == whole.summary
    monkeypatch.undo()
    actions = [r.action for r in queries.actions(spark, sf).collect()]
    assert actions == whole.actions and any("along a curve" in a for a in actions)
    found = [r.asDict() for r in queries.findings(spark, sf).collect()]
    assert found == [{"place": i} | f for i, f in enumerate(whole.findings, 1)]
    assert queries.summary(spark, sf).first().summary == whole.summary


def _planted(spark, rows=600):
    key = F.col("id")
    return spark.range(rows).select(
        key.alias("order"), F.concat(F.lit("R"), (key % 4).cast("string")).alias("Region"), F.when(key % 9 > 0, F.concat(F.lit("C"), (key * 7 % 5).cast("string"))).alias("Channel"),
        F.round(F.exp(key % 97 / 30) + key % 4 * 5, 2).alias("price"), (key % 97 * 2.5 + key % 3).alias("weight"),
    )


def test_summary_parts_share_one_grouping_of_cells(spark, monkeypatch):
    """No part copies rows to each of their levels, groups them once more, or counts all numbers of all columns."""
    from datascry.operators import profile
    from datascry.plans import analyse as plan

    df = _planted(spark)
    made, keys = [], []
    cells, counts = relations.level_cells, profile.all_key_counts
    monkeypatch.setattr(relations, "level_cells", lambda *a: made.append(a[1]) or cells(*a))
    monkeypatch.setattr(profile, "all_key_counts", lambda *a: keys.append(a[1]) or counts(*a))

    def rows(*args, **named):
        raise AssertionError("rows are read again")

    for module, name in ((relations, "_by_level"), (relations, "all_bin_edges"), (explore, "paretos")):
        monkeypatch.setattr(module, name, rows)
    rep = plan.work_out(plan.begin(df, row="order"), plan.SUMMARY)
    assert made == [["Region", "Channel", *[f"{c} (quintile)" for c in rep.numeric]]] and keys == [["Region", "Channel"]]
    assert [c for c in rep.numeric if "distinct" in rep.by[c]] == ["order"]
    monkeypatch.undo()
    plan.count_numbers(rep.source, rep.profiles)
    assert rep.by["price"]["distinct"] == df.select("price").distinct().count()
    monkeypatch.setattr(plan, "MOST_CELLS", 1)  # a scan for each category, overlap from rows
    apart = plan.work_out(plan.begin(df, row="order"), plan.SUMMARY)
    assert len(apart.cells) == len(apart.categories)

    def same(a, b):
        if isinstance(a, dict):
            return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
        return a == pytest.approx(b, rel=1e-6, abs=1e-9) if isinstance(a, float) else a == b

    for name in ("drivers", "associations_all", "segments", "paretos"):
        assert rep.lists[name] and len(rep.lists[name]) == len(apart.lists[name])
        assert all(same(a, b) for a, b in zip(rep.lists[name], apart.lists[name], strict=True)), name
    for r in (rep, apart):
        r.source.unpersist()


def test_actions_find_keys_by_counting_one_column(spark, monkeypatch):
    """Columns that repeat a value among the first rows are not counted; a key that repeats later is no key."""
    from datascry.operators import profile
    from datascry.plans import analyse as plan

    asked = []
    distinct = profile.distinct_numbers
    monkeypatch.setattr(profile, "distinct_numbers", lambda df, columns: asked.append(list(columns)) or distinct(df, columns))
    monkeypatch.setattr(plan, "FIRST_ROWS", 50)
    late = spark.range(300).select(F.when(F.col("id") > 250, 1.0).otherwise(F.col("id").cast("double")).alias("late"), (F.col("id") % 7).cast("double").alias("v"))
    rep = plan.begin(late.coalesce(1).union(late.filter("late = 1")))
    assert rep.quality["duplicates"] > 0 and asked == [["late", "v"], ["late"]]
    asked.clear()
    keyed = plan.begin(_planted(spark), row="order")
    assert keyed.quality["duplicates"] == 0 and asked[1:] == [["order"]] and len(asked[0]) == 3
    for r in (rep, keyed):
        r.source.unpersist()
