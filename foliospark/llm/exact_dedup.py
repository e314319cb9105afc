"""Exact dedup with a heavy-hitter split.

Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Digests that
occur very often (found with a Misra-Gries summary, then counted exactly) are decided map-side with a
broadcast table of at most 1/support rows. All other digests, none of which holds more than that share
of the rows, are grouped with an ordinary shuffle of (digest, doc_id): texts are never shuffled for it. The share is at most
SUPPORT, and less with many shuffle partitions: a digest that isn't broadcast then has half a partition's rows at most.

exact_dedup drops the copies where the texts are, if at most SMALL_ROWS distinct (digest, doc_id) go; beyond that rows and keys meet in a shuffle.

Defined cases: null text equals ''; an empty table gives an empty result; of equal texts the row with
the largest doc_id stays (null is smaller than any number); of rows that tie in text and doc_id
exactly one stays, and counts in group_size; very long texts are digested whole and stay where they are; columns beyond doc_id and text play no part,
whatever their names, and exact_dedup gives them back as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import ascii_lower, small, stored

SUPPORT = 0.001


def _support(spark: SparkSession) -> float:
    return min(SUPPORT, 0.5 / int(spark.conf.get("spark.sql.shuffle.partitions")))


def digest(text="text"):
    return F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))), 256)


def _decided(rows: DataFrame, groups: DataFrame, hint: bool) -> DataFrame:
    return rows.join(F.broadcast(groups) if hint else groups, "text_sha256")


def exact_groups(docs: DataFrame, support: float | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    support = support or _support(docs.sparkSession)
    rows = stored(
        docs.select("doc_id", digest().alias("text_sha256"), F.monotonically_increasing_id().alias("row_no")),
        "digests",
    )
    summary = (
        F.count(F.lit(1)).alias("group_size"),
        F.max(F.struct("doc_id", "row_no")).alias("best"),
    )
    # Misra-Gries: every digest with more than support * n rows is among at most 1/support candidates.
    frequent = rows.stat.freqItems(["text_sha256"], support)
    frequent = frequent.select(F.explode(frequent.columns[0]).alias("text_sha256"))
    least = max(2.0, rows.count() * support)
    winners = (
        rows.join(F.broadcast(frequent), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(*summary)
        .where(F.col("group_size") >= least)
    )
    winners = stored(winners, "winners")  # 1/support rows at most
    hot = _decided(rows, winners, True)
    cold = rows.join(F.broadcast(winners), "text_sha256", "left_anti")
    cold = _decided(cold, cold.groupBy("text_sha256").agg(*summary), False)
    return hot.unionByName(cold).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("best.row_no")).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, support: float | None = None) -> DataFrame:
    """docs without the rows that are copies; all columns stay as they are."""
    mark, key = "_fs_digest", "_fs_doc"
    several = exact_groups(docs, support).where("group_size > 1")
    # A row goes if its (text, doc_id) lost; a key that has both a winner and losers is a tie.
    fate = stored(
        several.groupBy(F.unhex("text_sha256").alias(mark), F.col("doc_id").alias(key)).agg(F.max("kept").alias("_fs_kept"), F.count(F.lit(1)).alias("_fs_n")),
        "fate",
    )
    marked = docs.withColumn(mark, F.unhex(digest()))

    def on(keys: DataFrame):
        return (marked[mark] == keys[mark]) & marked["doc_id"].eqNullSafe(keys[key])

    ties = fate.where("_fs_kept AND _fs_n > 1").select(mark, key)
    gone = small(fate.where("NOT _fs_kept OR _fs_n > 1").select(mark, key))
    rest = marked.join(gone, on(gone), "left_anti").select(*docs.columns)
    if ties.isEmpty():
        return rest
    ties = small(ties)
    tied = marked.join(ties, on(ties), "left_semi").dropDuplicates([mark]).select(*docs.columns)
    return rest.unionByName(tied)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
