"""Mixing sources to target weights by hierarchical budgeting, in DataFrame
functions only.

The token budget flows down a tree of domain, language and source.  At each
node it is split by the children's weights; what a child cannot use (its
subtree holds at most ``max_epochs`` times its tokens) goes to its siblings
first, and only what no sibling can use is left to the ancestors' other
children.  Each leaf then takes whole seeded epochs of its documents and, of
one more epoch, the longest prefix in seeded order that its budget pays for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from datascry.llm import common

LEVELS = ("domain", "lang", "source")


def count_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null text: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column, domains: int = 3) -> Column:
    """The default first level: sources dealt to ``domains`` domains by 32 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(source.cast("binary")), 1, 8), 16, 10).cast("long")
    return F.concat(F.lit("domain"), (bits % domains).cast("string"))


def seeded(seed: int, epoch: Column, name: Column, again: Column) -> Column:
    """48 bits of an MD5: a document's place in an epoch, 0 to 2**48 - 1.

    The same in every engine.  ``again`` tells apart rows with one id.
    """
    whole = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), name, again)
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 12), 16, 10).cast("long")


def water_fill(nodes: DataFrame, parent: list[str], order: list[str]) -> DataFrame:
    """``nodes`` (``budget`` of the parent, ``weight``, ``capacity``) with ``share``.

    Siblings fill in the order of capacity per weight; those that the common
    level would overfill get their capacity, the others divide what is left by
    weight.  A node without weight gets nothing.
    """
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(0.0))
    w = W.partitionBy(*parent).orderBy("ratio", *order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    after = w.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = F.try_divide(
        F.col("budget") - F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("capacity"))).over(before), F.lit(0.0)),
        F.sum("weight").over(after),
    )
    got = nodes.withColumn("ratio", ratio).withColumn("level", level)
    got = got.withColumn("full", F.col("ratio") <= F.col("level"))
    # the first node that is not full sets the level of all that follow
    held = F.min(F.when(~F.col("full") & (F.col("weight") > 0), F.struct("ratio", *order, "level"))).over(
        W.partitionBy(*parent)
    )["level"]
    share = F.when(F.col("weight") <= 0, F.lit(0.0)).when(F.col("full"), F.col("capacity")).otherwise(F.col("held") * F.col("weight"))
    return got.withColumn("held", held).withColumn("share", share).drop("ratio", "level", "full", "held")


def _on(path: list[str], prefix: str) -> Column:
    hit = F.lit(True)
    for c in path:
        hit = hit & F.col(c).eqNullSafe(F.col(prefix + c))
    return hit


def _prefixed(path: list[str], prefix: str) -> list[Column]:
    return [F.col(c).alias(prefix + c) for c in path]


def leaf_budgets(leaves: DataFrame, total: float, weights: DataFrame | None = None, max_epochs: int = 4) -> DataFrame:
    """Leaves (``domain, lang, source, tokens, docs``) with their ``budget`` in tokens.

    ``weights`` (``domain, lang, source, weight``) names a node by nulls below
    its level; nodes that it does not name weigh 1.
    """
    out = leaves.withColumn("capacity", (F.col("tokens") * max_epochs).cast("double")).withColumn("budget", F.lit(float(total)))
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        at = out.groupBy(*path).agg(F.first("budget").alias("budget"), F.sum("capacity").alias("capacity"))
        if weights is None:
            at = at.withColumn("weight", F.lit(1.0))
        else:
            named = weights.filter(F.col(level).isNotNull())
            for lower in LEVELS[depth + 1 :]:
                named = named.filter(F.col(lower).isNull())
            at = at.join(named.select(*_prefixed(path, "w_"), F.col("weight").cast("double")), _on(path, "w_"), "left")
            at = at.drop(*["w_" + c for c in path]).withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        # a common column, so that the top level has a key to partition by too
        at = water_fill(at.withColumn("root", F.lit(0)), ["root", *path[:-1]], [level])
        shares = at.select(*_prefixed(path, "s_"), "share")
        out = out.drop("budget").join(shares, _on(path, "s_")).drop(*["s_" + c for c in path])
        out = out.withColumnRenamed("share", "budget")
    return out.drop("capacity").withColumn("budget", F.floor(F.col("budget") + F.lit(1e-6)).cast("long"))


def _same_join(plan: DataFrame, more: DataFrame, path: list[str]) -> DataFrame:
    """``plan`` with the further columns that ``more`` has for some leaves."""
    more = more.select(*[F.col("l_" + c).alias("m_" + c) for c in path], *[c for c in more.columns if c[:2] != "l_"])
    hit = F.lit(True)
    for c in path:
        hit = hit & F.col("l_" + c).eqNullSafe(F.col("m_" + c))
    return plan.join(more, hit, "left").drop(*["m_" + c for c in path])


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    budget_ratio: float = 1.0,
    max_epochs: int = 4,
    seed: int = 20240607,
    bucket_docs: int = 2048,
    domain: Column | None = None,
) -> DataFrame:
    """Rows of ``docs`` that the mix takes, once for each epoch that takes them.

    Adds ``mix_domain``, ``mix_tokens`` and ``mix_epoch`` (0 is the first).
    The budget is ``budget_ratio`` times all tokens (words) of ``docs``.  In
    its last epoch a leaf's documents are ordered by seeded hash, then id; it
    takes the longest prefix within the budget, so it stays at most one
    document short.  Leaves are cut into buckets of the hash of about
    ``bucket_docs`` documents: sums over buckets find the one in which the
    budget ends, and only that bucket is put in order, so no leaf is ever
    gathered in a task.

    Null text: no tokens, taken with every whole epoch.  Null lang or source
    is a leaf of its own.  Rows that repeat an id are told apart by a hash of
    their text; rows that agree in both are taken or left together.  An empty
    table gives no rows; other columns stay, clashing ones of ours are renamed
    by leading underscores.
    """
    spark = docs.sparkSession
    path = list(LEVELS)
    out_domain, out_tokens, out_epoch = common.fresh(docs, "mix_domain", "mix_tokens", "mix_epoch")
    rows = docs.select(
        (domain if domain is not None else domain_of(F.col("source"))).alias("domain"),
        F.col("lang"),
        F.col("source"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("again"),
        count_words(F.col("text")).alias("tokens"),
        F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("doc"),
    )
    thin = common.cut(rows.drop("doc"), "mix-rows")
    leaves = thin.groupBy(*path).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    total = (thin.agg(F.sum("tokens")).first()[0] or 0) * budget_ratio
    plan = leaf_budgets(leaves, total, weights, max_epochs)
    whole = F.least(F.lit(max_epochs), F.coalesce(F.try_divide(F.col("budget"), F.col("tokens")).cast("long"), F.lit(0)))
    plan = plan.select(
        *_prefixed(path, "l_"),
        whole.cast("int").alias("whole"),
        F.when(whole < max_epochs, F.col("budget") - whole * F.col("tokens")).otherwise(F.lit(0)).alias("rest"),
        F.floor(F.col("docs") / bucket_docs + 1).cast("long").alias("buckets"),
    )
    # a written table has a known size: it is broadcast only while that is small
    plan = common.cut(plan, "mix-plan")

    place = seeded(seed, F.col("whole"), F.col("id"), F.col("again"))
    bucket = F.floor(F.col("place") / (F.lit(2.0**48) / F.col("buckets"))).cast("long")

    def placed(df: DataFrame, leaf: DataFrame) -> DataFrame:
        df = df.join(leaf, _on(path, "l_")).drop(*["l_" + c for c in path])
        return df.withColumn("place", place).withColumn("bucket", bucket)

    run = W.partitionBy(*path).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    # the budget ends in the last bucket that begins within it
    ends = (
        placed(thin, plan)
        .groupBy(*path, "bucket")
        .agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
        .withColumn("before", F.coalesce(F.sum("tokens").over(run), F.lit(0)))
        .filter("before <= rest")
        .groupBy(*path)
        .agg(F.max(F.struct("bucket", "before")).alias("end"))
        .select(*_prefixed(path, "l_"), "end")
    )
    plan = common.cut(_same_join(plan, ends, path), "mix-ends")
    mine = F.struct("place", "id", "again")
    in_order = W.partitionBy(*path).orderBy(mine)
    last = (
        placed(thin, plan)
        .filter(F.col("bucket") == F.col("end.bucket"))
        .withColumn("upto", F.sum("tokens").over(in_order) + F.col("end.before"))
        .filter("upto <= rest")
        .groupBy(*path)
        .agg(F.max(mine).alias("last"))
        .select(*_prefixed(path, "l_"), "last")
    )
    plan = common.cut(_same_join(plan, last, path), "mix-last")
    more = (F.col("rest") > 0) & (
        (F.col("bucket") < F.col("end.bucket"))
        | ((F.col("bucket") == F.col("end.bucket")) & F.coalesce(mine <= F.col("last"), F.lit(False)))
    )
    return (
        placed(rows, plan)
        .withColumn("copies", F.col("whole") + F.when(more, 1).otherwise(0))
        .filter("copies > 0")
        .select(
            "doc",
            F.col("domain").alias(out_domain),
            F.col("tokens").alias(out_tokens),
            F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias(out_epoch),
        )
        .select("doc.*", out_domain, out_tokens, out_epoch)
    )
