"""The corpus pipeline: documents through five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vislens.llm.queries import CAPACITY, packing_rows, read, training_labels
from vislens.llm.contamination import drop_contaminated
from vislens.llm.packing import pack
from vislens.llm.simhash import drop_near_copies
from vislens.llm.toxicity import drop_toxic, fit_toxicity
from vislens.llm.unit_dedup import drop_repeats
from vislens.session import cut_lineage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger does not call toxic. Only labels of the training fold are learnt from."""
    return drop_toxic(docs, fit_toxicity(docs, training_labels(spark, sf_dir)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return drop_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines and sentences that an earlier place has; n_chars follows."""
    return drop_repeats(docs, length_col="n_chars")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: see the operator."""
    return pack(packing_rows(docs), "n_bytes", CAPACITY)


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("repeats", repeats),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL has no tagger, SimHash or best fit.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
