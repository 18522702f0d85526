"""The corpus pipeline: five stages, each written as Parquet and reread as the next one's documents.

Stages work on all that their predecessor kept.  All but the last return the
columns of ``documents``; the last returns each remaining document's id, its
sampled piece ids and whether decoding gave the text back.

``ORACLE_SQL`` is None: SQL can express neither the trained classifier nor the
sampled segmentation.  ``tests/llm`` compares ``run`` with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkprep._fs import scratch_dir
from sparkprep.llm.decontaminate import decontaminate
from sparkprep.llm.exact_dedup import deduplicate
from sparkprep.llm.jaccard import one_of_each
from sparkprep.llm.registry import read
from sparkprep.llm.sentence_pieces import encoded_and_checked
from sparkprep.llm.toxicity import without_toxic

TOKENIZER = "piece_bpe_32k.model"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(6) Documents that the classifier rejects go."""
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(8) Of equal texts, the longest original with the smallest id stays."""
    return deduplicate(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(10) Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the smallest id stays."""
    return one_of_each(docs, k=5, p=80, q=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(7) Documents that hold a window of ten consecutive words of a benchmark item go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(2) Sampled segmentations of what is left, checked by decoding."""
    return encoded_and_checked(docs, TOKENIZER)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; their tables stay in the shared scratch folder until the result has been read."""
    store = scratch_dir(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{store}/{i}-{name}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
