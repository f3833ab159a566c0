"""The corpus pipeline: quality, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.

Defined cases of every stage: null text is empty text and null metadata a value of its own; of rows that repeat, exact
dedup leaves one; ties are settled by length, then by the smallest id, a null id last; a text of any length is read
whole; an empty table gives an empty result; without labels the quality stage keeps and the mixture leaves every
document; columns that the table has beyond those of ``documents`` are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listloom.llm import common, exact_dedup, mixing, ngram_join, packing, quality
from listloom.llm.queries import tokenizer_path

#: Shares of what the mixture leaves: little of the low rest, few toxic pages, the others as they are.
TARGETS = {"low": 0.01, "high": 0.98, "toxic": 0.01}
#: After two stages of copy removal nothing is repeated; the mixture's size follows from the spared domain.
MOST_COPIES = 1.0
#: No document that is likelier of this domain than of any other is dropped, whatever the targets say.
SPARED = "high"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    return quality.keep_good(docs, _labels(spark, sf_dir))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join."""
    return ngram_join.drop_near_copies(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say: low and toxic ones are thinned until their shares fit."""
    return mixing.mixed(docs, _labels(spark, sf_dir), TARGETS, most=MOST_COPIES, spared=SPARED, scale=None)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    # Executors carry the memory of four stages by now; remembered words make up for smaller slices.
    pieces = packing.tokenize_pieces(docs, tokenizer_path(), slice_bytes=512 << 10, known_words=100_000)
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.place_pieces(digests)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram jaccard join", near_stage),
    ("mixing sources", mix_stage),
    ("best-fit packing", pack_stage),
]

#: Trained classifiers and a BPE tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stage(docs, f"pipeline{k}")
    return docs
