"""A corpus pipeline: quality, near duplicates, secrets, mixing, token ids.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and reread as the next one's
docs.  All but the last return the columns of documents.

Every stage takes null, empty and very long texts, repeated rows and empty tables
as its operator's docstring says, and passes further columns on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import bpe, jaccard, mixing, quality, secrets
from faultline.llm._cut import cut, small_batches
from faultline.llm.queries import TARGETS, word_bpe_path
from faultline.session import ship_package
from faultline.sources.tables import read_table


def _ready(spark: SparkSession) -> None:
    ship_package(spark)
    small_batches(spark)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut."""
    _ready(spark)
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    _ready(spark)
    return jaccard.keep_one(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars as it is then."""
    _ready(spark)
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates say that bring languages to their target weights, at least once."""
    _ready(spark)
    return mixing.spread(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"), TARGETS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    _ready(spark)
    return bpe.encode(docs, word_bpe_path()).withColumn("n_tokens", F.size("ids").cast("long")).drop("text")


STAGES = [("quality classifier", good), ("n-gram Jaccard join", distinct), ("secret scans", redacted), ("mixing", mixed), ("BPE", tokens)]
# The classifier, the fitted rates and the merges are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return docs
