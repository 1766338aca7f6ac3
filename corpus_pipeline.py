"""Documents to training sequences: filter, deduplicate, decontaminate, pack.

``run`` applies the stages to ``documents``; each stage's rows are written and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitlake.llm import common, decontaminate, line_dedup, near_dedup, packing, quality
from fitlake.session import written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from labelled rows of this table, scores one half or more."""
    return quality.accepted(docs, quality.learn(docs, common.table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten or more of them share; n_chars follows the text."""
    out = line_dedup.dedup_lines(common.aside(docs, line_dedup.ADDED), min_chars=1, min_docs=10)
    return common.restored(out, docs, {
        "text": F.col("kept"), "n_chars": F.length("kept").cast(dict(docs.dtypes).get("n_chars", "long"))})


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates (five-word shingles, 0.8)."""
    return near_dedup.representatives(docs, words=5, percent=80)


def clean_of_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item."""
    marked = decontaminate.scan(common.aside(docs, decontaminate.ADDED),
                                common.table(spark, sf_dir, "benchmark"), window=10)
    return common.restored(marked.where(~F.col("contaminated")), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2048 tokens."""
    return packing.pack(docs, size=2048)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", one_of_each),
    ("benchmark_decontamination", clean_of_tests),
    ("best_fit_packing", pack_sequences),
]

#: A fitted classifier and a tokenizer cannot be stated in SQL; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
