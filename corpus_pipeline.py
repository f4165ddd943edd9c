"""A training-corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. No stage looks at more than its own input and the tables beside it.
Its output must be written before the next stage begins, which removes its intermediates.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import decontamination, ngram_jaccard_join, quality_classifier, sharding, source_mixing
from tidewright.llm._shared import discard, materialize, scratch, sweep
from tidewright.llm.queries import fitted_quality

#: Folders of the last stage; its output is written before the next one starts, which removes them.
_left: list[str] = []


def _stage(apply):
    """Let a stage remove what the stage before it has left in the shared folder."""

    @functools.wraps(apply)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, _left)
        with scratch() as paths:
            out = apply(spark, docs, sf_dir)
        _left.extend(paths)
        return out

    return stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good.

    Null and empty texts are scored as empty ones; repeated rows are judged alike; labels of no
    document, or of one kind only, teach nothing, and then every row stays. Empty in, empty out.
    """
    return quality_classifier.keep_good(docs, fitted_quality(spark, docs, sf_dir))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard 0.8 or more.

    The smallest doc_id stays. Texts without words are no copies and stay; of rows that share a
    doc_id one stays; rows with a null doc_id can't be named and stay. Empty in, empty out.
    """
    return ngram_jaccard_join.keep_one_per_group(docs, shingle=5, num=8, den=10)


@_stage
def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated: fewer than a twentieth of their words lie in benchmark windows.

    Rows are judged by their text, whatever their doc_id; null, empty and wordless texts stay, as
    does everything if the benchmark is empty. Empty in, empty out.
    """
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with raked probabilities.

    Null sources and languages are a category; null and empty texts follow the probability of
    their cell; rows that share a doc_id are drawn together. Empty in, empty out.
    """
    return source_mixing.keep_sample(docs)


@_stage
def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each with its shard, slot and bucket, in columns of those names.

    Null texts and doc_ids are dealt like any other; repeated rows get a slot each. Empty in, empty out.
    """
    return sharding.shard_documents(docs)


STAGES = [
    ("quality", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", benchmark_free),
    ("mixing", mixed),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return docs


#: A learned classifier and seeded shuffles can't be said in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None
