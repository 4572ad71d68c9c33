"""A corpus pipeline of five stages over the table ``documents``.

Each stage works on all that the one before kept and returns the columns of
documents; the last one adds where in the mix a document stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from datascry.llm import common, decontaminate, jaccard_join, line_dedup, mixing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a quality rule rejects; flagged words are learned
    from a bounded sample of the labels."""
    flagged = quality.learn_flagged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.filter_quality(docs, quality.with_flagged(flagged))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated runs of lines, and documents that consist of them alone."""
    cleaned = line_dedup.remove_repeated_lines(docs)
    n_lines, n_gone = cleaned.columns[-2:]
    return cleaned.filter(f"{n_gone} = 0 or {n_gone} < {n_lines}").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles, Jaccard 0.8 or more."""
    return jaccard_join.keep_one_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a 10-word window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal shares for domains, then languages, then sources, as far as four
    epochs reach."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing to target weights", mix),
]

#: Repeated runs of lines are beyond SQL; tests hold each stage's operator against
#: brute force, and the stages together on planted documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written out before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
