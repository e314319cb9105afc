"""Mixing sources to target weights by Poisson replication.

Every source gets a repetition rate, target share * rows / rows of the source. A document's number of
copies is the Poisson quantile, at that rate, of a uniform number hashed from seed and doc_id: a document
gets the same count in every run, whatever the partitioning. Rates over CHUNK are split into equal
parts with a hash each, as a sum of Poisson numbers is one. The copies are then dealt to partitions by
a hashed key and sorted by it, which is the global shuffle.

Defined cases: null is a source of its own; a source that weights don't name has weight 0; a source
that documents don't have changes nothing (the shares of the others are scaled up); a null doc_id is
replaced by the text's MD5; repeated doc_ids, and repeated rows, share a count; null, empty and very long texts are copied like any other; empty documents
give an empty result; columns named copy_no or shuffle_key are replaced by the result's own, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import stored, unit_hash

SEED = "folio"
CHUNK = 32.0
#: Terms of the distribution function: with a mean of 32 the rest is far below 2**-52.
TERMS = 130
#: Up to so many sources (short rows) are broadcast; more are joined with salted keys.
BROADCAST_SOURCES = 10_000
SALTS = 16


def _identity() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text")), F.lit(""))


def _distribution(mean: Column) -> Column:
    """P(X <= k) for k = 0 .. TERMS."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["all"])


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0) -> DataFrame:
    """source, rows, rate: how often a document of that source is repeated on average.

    weights None: every source gets the same share. size: rows of the mix per row of docs.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.lit(None).cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(named, F.coalesce("source", F.lit(""))).cast("double"), F.lit(0.0))
    counts = stored(counts.withColumn("weight", weight), "sources")
    whole = counts.agg(F.sum("rows").alias("rows"), F.sum("weight").alias("weight")).first()
    rate = F.lit(0.0)
    if whole["weight"]:
        rate = F.col("weight") * whole["rows"] * size / (F.col("rows") * whole["weight"])
    return counts.select("source", "rows", rate.alias("rate"))


def replicate(
    docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, seed: str = SEED
) -> DataFrame:
    """docs repeated to the target weights and shuffled, with the columns copy_no and shuffle_key."""
    parts = F.greatest(F.ceil(F.col("rate") / CHUNK), F.lit(1)).cast("int")
    rates = repetition_rates(docs, weights, size).where(F.col("rate") > 0)
    rates = stored(
        rates.select(F.col("source").alias("_fs_source"), parts.alias("_fs_parts"), _distribution(F.col("rate") / parts).alias("_fs_cdf")),
        "rates",
    )
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    marked = docs
    on = docs["source"].eqNullSafe(rates["_fs_source"])
    if few:
        joined = docs.join(F.broadcast(rates), on)
    else:  # a hot source is spread over SALTS tasks
        rates = rates.withColumn("_fs_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = docs.withColumn("_fs_row_salt", F.pmod(F.xxhash64(_identity()), F.lit(SALTS)).cast("int"))
        on = marked["source"].eqNullSafe(rates["_fs_source"]) & (marked["_fs_row_salt"] == rates["_fs_salt"])
        joined = marked.join(rates, on)
    def below(part: Column) -> Column:
        """How many entries of the table are at or under the number of that part, which is hashed once."""
        u = F.array(unit_hash(F.lit(seed), _identity(), part.cast("string")))
        return F.get(F.transform(u, lambda u: F.size(F.filter("_fs_cdf", lambda c: c <= u))), F.lit(0))

    drawn = F.aggregate(F.sequence(F.lit(1), F.col("_fs_parts")), F.lit(0), lambda acc, part: acc + below(part))
    count = F.array(F.when(F.col("_fs_parts") == 1, below(F.lit(1))).otherwise(drawn))
    numbers = F.flatten(F.transform(count, lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))))
    kept = [c for c in docs.columns if c not in ("copy_no", "shuffle_key")]
    out = joined.select(*kept, _identity().alias("_fs_id"), F.explode(numbers).alias("copy_no"))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), "_fs_id", "copy_no")), 1, 15), 16, 10).cast("long")
    out = out.select(*kept, "copy_no", key.alias("shuffle_key"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(table: str = "documents") -> str:
    return f"""
WITH s AS (SELECT source, count(*) AS n FROM {table} GROUP BY source),
rates AS (SELECT source, 1.0 * (SELECT count(*) FROM {table}) / ((SELECT count(*) FROM s) * n) AS rate FROM s),
parts AS (SELECT source, rate, greatest(CAST(ceil(rate / 32) AS BIGINT), 1) AS parts FROM rates),
means AS (SELECT source, parts, rate / parts AS mean FROM parts),
cdf AS (
  SELECT source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM means, (SELECT unnest(range(0, 131)) AS k)),
tables AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
ids AS (SELECT d.*, coalesce(CAST(doc_id AS VARCHAR), md5(text), '') AS ident FROM {table} d),
drawn AS (
  SELECT d.*, list_sum(list_transform(range(1, m.parts + 1), lambda part:
           len(list_filter(t.cs, lambda c: c <= CAST('0x' || substr(md5('folio|' || d.ident || '|' || part), 1, 13) AS BIGINT) / 4503599627370496.0)))) AS n
  FROM ids d JOIN means m ON d.source IS NOT DISTINCT FROM m.source JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT *, unnest(range(1, CAST(n AS BIGINT) + 1)) AS copy_no FROM drawn WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, CAST(copy_no AS INTEGER) AS copy_no,
       CAST('0x' || substr(md5('folio|order|' || ident || '|' || copy_no), 1, 15) AS BIGINT) AS shuffle_key
FROM copies
"""


ORACLE = oracle()
