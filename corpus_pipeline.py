"""The corpus pipeline: documents in, packed training sequences out.

Every stage works on all rows that the stage before it kept, and all but the last return the columns of documents.
A stage's intermediate tables are deleted when a later stage begins on rows that no longer read them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, langid, packing, quality, simhash
from lodestar.llm.common import unpacked
from lodestar.llm.queries import WORD_BPE
from lodestar.session import collecting, discard, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document that needs more phrases per character than this in its nearest language is in none of them.
MAX_PHRASE_RATE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality rules keep."""
    return unpacked(quality.judged(docs).filter("kept"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose text is in one of the languages learnt from the labelled documents."""
    samples = langid.sample(docs)
    if not samples:  # no labelled document, so no language to tell: nothing is rejected for it
        return docs
    found = langid.identified(docs, samples)
    return unpacked(found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("rate") <= MAX_PHRASE_RATE)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: the one with the smallest id."""
    return unpacked(simhash.deduplicated(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in which no benchmark item is found."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    return packing.packed(docs, WORD_BPE)


#: Intermediate tables of stages that have run, by application.
_left: dict[str, list[str]] = {}


def _tidy(stage: Stage) -> Stage:
    """The stage, deleting what earlier stages have left behind."""

    @wraps(stage)
    def tidied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left.setdefault(spark.sparkContext.applicationId, [])
        names = {path.rsplit("/", 1)[1] for path in left}
        if left and names.isdisjoint(part for file in docs.inputFiles() for part in file.split("/")):
            discard(spark, left)
            left.clear()
        with collecting() as made:
            found = stage(spark, docs, sf_dir)
        left += made
        return found

    return tidied


STAGES = [
    ("quality rules", _tidy(quality_rules)),
    ("language ID", _tidy(language_id)),
    ("SimHash near-dedup", _tidy(near_dedup)),
    ("benchmark decontamination", _tidy(decontamination)),
    ("packing", _tidy(pack)),
]

#: Language identification, the hash of SimHash and tokenization go beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
