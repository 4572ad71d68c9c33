"""How filters overlap under every order of applying them, from one pass over documents.

The subsets of already-applied filters form a lattice; applying filter f after
subset S is one of its k * 2**(k-1) edges.  What a document does at an edge
depends on S and f alone, so documents are counted by edge, and each of the k!
orders is a path of k edges whose figures are looked up, not computed again.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from datascry.llm.annotate import _quoted

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters A to D; a null text is empty."""
    said = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(said, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    n, apart = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(said, "[^A-Z]+", ""))
    return {
        "A": n < 100,
        "B": 100 * apart < 80 * n,
        "C": 100 * capitals.cast("long") > 10 * F.length(said).cast("long"),
        "D": said.rlike("[#$%&*|]"),
    }


def label_flags(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, good, toxic``, one row per id: whether any of its labels says so."""
    flags = labels.filter(F.col(_quoted(id_col)).isNotNull()).groupBy(F.col(_quoted(id_col)).alias("id"))
    return flags.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))


def failure_cells(
    docs: DataFrame, failures: Mapping[str, Column], labels: DataFrame, part: Column, duplicate: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``part, mask, good, toxic, n``: documents by what they fail.

    Bit i of ``mask`` is the i-th of ``failures``; with ``duplicate`` the next bit
    is set where a smaller id has the same text anywhere in the table.  Rows without id
    neither are copies nor have any, and have no labels; equal rows all count.

    Equal texts fail alike, so copies are counted by (text, part, labels) before
    the texts' rows meet: no key holds more than a row for each part and label.
    """
    bits = [F.when(cond, F.lit(1 << i)).otherwise(F.lit(0)) for i, cond in enumerate(failures.values())]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    # rows without id are dealt by where they were read, since they meet nothing
    dealt = F.when(F.col(_quoted(id_col)).isNull(), F.spark_partition_id() + 1).otherwise(0)
    rows = docs.select(
        F.col(_quoted(id_col)).alias("id"), dealt.alias("deal"), part.alias("part"), F.unhex(F.sha2(F.coalesce(F.col(_quoted(text_col)), F.lit("")), 256)).alias("digest"), mask.alias("mask")
    )
    once = rows.groupBy("id", "deal", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    marked = once.join(label_flags(labels, id_col).withColumn("deal", F.lit(0)), ["id", "deal"], "left")
    marked = marked.select("id", "part", "digest", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")
    kind = ["part", "mask", "good", "toxic"]
    if not duplicate:
        return marked.groupBy(*kind).agg(F.sum("n").alias("n"))
    copies = marked.groupBy("digest", *kind).agg(
        F.coalesce(F.sum(F.when(F.col("id").isNotNull(), F.col("n"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("bare"),
        F.min("id").alias("least"),
        F.min_by("n", "id").alias("n_least"),  # rows of one id and text are one row here
    )
    first = F.col("least") == F.min("least").over(W.partitionBy("digest"))
    firsts = F.when(first, F.col("n_least")).otherwise(0)
    split = copies.withColumn("firsts", firsts).select(
        *[c for c in kind if c != "mask"],
        F.inline(
            F.array(
                F.struct("mask", (F.col("firsts") + F.col("bare")).alias("n")),
                F.struct((F.col("mask") + F.lit(1 << len(failures))).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")),
            )
        ),
    )
    return split.filter("n > 0").groupBy(*kind).agg(F.sum("n").alias("n"))


def lattice_edges(cells: DataFrame, k: int) -> DataFrame:
    """``part, subset, f`` with the counts of each edge, and ``shapley``: what filter f
    removes, over all orders, at whatever step it stands."""
    edges = [(s, f) for s in range(1 << k) for f in range(k) if not s >> f & 1]
    each = cells.select("*", F.explode(F.array(*[F.struct(F.lit(s).alias("subset"), F.lit(f).alias("f"), F.lit(1 << f).alias("bit")) for s, f in edges])).alias("e"))
    bit = F.col("e.bit")
    fails, clean = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(F.col("e.subset")) == 0

    def count(when: Column) -> Column:
        return F.sum(F.when(when, F.col("n")).otherwise(0)).cast("long")

    summed = each.groupBy("part", F.col("e.subset").alias("subset"), F.col("e.f").alias("f")).agg(
        count(~fails & clean).alias("kept"),
        count(fails & clean).alias("removed"),
        count(fails & ~clean).alias("redundant"),
        count(F.col("mask") == bit).alias("unique_fails"),
        count(fails & clean & F.col("good")).alias("good_lost"),
        count(fails & clean & F.col("toxic")).alias("toxic_lost"),
    )
    # orders that pass an edge: those of the filters before it times those after it
    paths = F.element_at(F.array(*[F.lit(factorial(j) * factorial(k - 1 - j)) for j in range(k)]), F.bit_count("subset") + 1)
    return summed.withColumn("shapley", F.sum(F.col("removed") * paths).over(W.partitionBy("part", "f")).cast("long"))


def permutation_steps(spark: SparkSession, names: str) -> DataFrame:
    """``filter_order, step, subset, f`` of all orders of the filters: k! * k rows."""
    rows = []
    for order in permutations(range(len(names))):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(names[i] for i in order), step, before, f))
            before |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, subset int, f int")


def audit_orders(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``part, filter_order, step`` with :data:`COUNTS` and ``shapley`` of the filters A
    to E under all 120 orders, for each part (null: the empty string).

    Every part has all 600 rows, zeros included; an empty table has none.
    """
    failures = text_failures(F.col(_quoted(text_col)))
    names = "".join(failures) + "E"
    cells = failure_cells(docs, failures, labels, F.coalesce(F.col(_quoted(part_col)), F.lit("")), True, id_col, text_col)
    steps = permutation_steps(docs.sparkSession, names)
    met = lattice_edges(cells, len(names)).join(F.broadcast(steps), ["subset", "f"])  # 600 rows
    return met.select("part", "filter_order", "step", *COUNTS, "shapley")
