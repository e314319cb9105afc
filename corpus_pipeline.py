"""The corpus pipeline: language ID, exact dedup, near dedup, decontamination, mixing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. run() applies
them to the documents, each stage's rows written as Parquet and read again as the next one's docs, so a
lost executor costs no more than the stage it was in. The tables that a stage's operator stored on the way belong to the run, and go when
the stage's rows are written; those that the rows returned are read from go when the process ends. Runs don't touch each other's tables.

Stages called by hand, one after another, share one list of tables: as a stage begins, the tables of those before are removed, unless the docs given
still read them, so a stage's result is to be written before the next one begins.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, empty tables and further columns as the docstring of its operator
says, and gives all columns back as they are; what a stage adds to that is in its own docstring.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import TEXT_ROWS, batch_rows, drop_tables, recording, stored
from foliospark.llm.decontamination import drop_leaks
from foliospark.llm.exact_dedup import exact_dedup
from foliospark.llm.language_id import UNKNOWN, held_out, identify, trained
from foliospark.llm.mixing import replicate
from foliospark.llm.near_dedup import near_dedup


#: A text goes if its bits per byte are over MARGIN times the QUANTILE of labelled texts that trained nothing, of which LEAST are needed.
QUANTILE = 0.999
MARGIN = 1.5
LEAST = 100

#: Tables that stages called by hand have stored and that are still there.
_TABLES: list[str] = []


def stage(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @functools.wraps(f)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, _TABLES, needed_by=docs)
        with recording(_TABLES):
            return f(spark, docs, sf_dir)

    return begun


def bits_bound(docs: DataFrame, model: dict) -> float | None:
    """Bits per byte beyond which a text is in none of the learned languages; None with too few labelled texts to tell."""
    labelled = docs.where(held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rates = identify(labelled, model, keep=[]).where(F.col("lang_pred") != UNKNOWN)
    with batch_rows(docs.sparkSession, TEXT_ROWS):
        n, rate = rates.agg(F.count(F.lit(1)), F.percentile_approx("bits_per_byte", QUANTILE)).first()
    return MARGIN * rate if n >= LEAST else None


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter go, and those that no learned language explains. The model learns as in op7.

    Where no row has a lang nothing is learned, and all documents with a letter stay.
    """
    columns = docs.columns
    model = trained(docs)
    if not model["langs"]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    out = identify(docs, model, keep=columns).where(F.col("lang_pred") != UNKNOWN)
    bound = bits_bound(docs, model)
    return (out if bound is None else out.where(F.col("bits_per_byte") <= bound)).select(*columns)


@stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) the row with the largest doc_id stays."""
    return exact_dedup(docs)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id stays; texts without a word all stay."""
    return near_dedup(docs)


@stage
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a window of a benchmark item go; with an empty benchmark none does."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets the same share; the columns copy_no and shuffle_key are added."""
    return replicate(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    between: list[str] = []
    for k, (_, step) in enumerate(STAGES):
        mine: list[str] = []
        with recording(mine):
            docs = step.__wrapped__(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            before, between = between, []
            with recording(between):
                docs = stored(docs, f"stage{k}")
            drop_tables(spark, [*before, *mine], needed_by=docs)
    return docs


#: Language models and near-duplicate classes can't be expressed in SQL.
ORACLE_SQL = None
