"""A training corpus in five stages: each reads what the one before it kept.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``docs``, with
those rows or texts that the operator keeps. The last one returns the mix in training order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.llm import decontaminate, langid, linededup, minhash, mixing
from outlay.llm.common import materialise, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters or with a doubtful language go."""
    return langid.reject_unknown(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are cut out of the texts; a document that loses all its lines goes."""
    clean = linededup.dedup_lines(docs, counts=("__lines", "__deleted"))
    return clean.where((F.col("__deleted") < F.col("__lines")) | (F.col("__lines") == 0)).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five-word shingles, 0.8)."""
    return minhash.keep_firsts(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not contain the benchmark."""
    return decontaminate.remove_documents(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, some of them several times, in the order of training."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language id", identify_language),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix),
]

# The first stage's classifier cannot be put into SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
