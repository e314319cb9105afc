"""Term statistics: frequencies, document frequencies, profiles, TF-IDF vectors, cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as T


def term_frequency(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, term, tf of the content words."""
    words = docs.select(doc, F.explode(T.content_tokens(F.col(text))).alias("term"))
    return words.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """term, df; a (doc, term) pair is a row of tf, so no distinct is needed."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def folder_terms(tf: DataFrame, filed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """folder_id, term, count over the filed documents (doc, folder_id)."""
    return tf.join(filed, doc).groupBy("folder_id", "term").agg(F.sum("tf").alias("count"))


def apply_delta(profile: DataFrame, delta: DataFrame, keys: tuple[str, ...] = ("folder_id", "term"), value: str = "count") -> DataFrame:
    """A profile with signed changes added; what falls to 0 or below goes. Learning and unlearning in one."""
    both = profile.select(*keys, value).unionByName(delta.select(*keys, value))
    return both.groupBy(*keys).agg(F.sum(value).alias(value)).where(F.col(value) > 0)


def idf(df: Column, n_docs: Column) -> Column:
    return F.ln((n_docs + 1) / (F.coalesce(df, F.lit(0)) + 1)) + 1


def weights(counts: DataFrame, key: str, df: DataFrame, n_docs: DataFrame, count: str = "tf") -> DataFrame:
    """key, term, w: TF-IDF weights. df: term, df. n_docs: one row, n."""
    known = counts.where(F.col(count) >= 1).join(df, "term", "left")
    return known.crossJoin(F.broadcast(n_docs)).select(key, "term", ((1 + F.ln(count)) * idf(F.col("df"), F.col("n"))).alias("w"))


def cosine(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """a_key, b_key, cos for the pairs that share a term. a, b: key, term, w; b is the side with few keys, say folders.

    b's unit vectors are gathered per term (a row has at most as many entries as b has keys), so that a meets them, and its own
    norm, in one join on the term and one grouping: a's rows are shuffled twice, whatever the number of keys.
    """
    norms = b.groupBy(b_key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nb"))
    unit = b.join(norms, b_key).select("term", F.struct(F.col(b_key).alias("key"), F.try_divide("w", "nb").alias("u")).alias("e"))
    by_term = unit.groupBy("term").agg(F.collect_list("e").alias("others"))
    return _dots(a.join(by_term, "term", "left"), a_key, b_key)


def _dots(rows: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """a_key, b_key, cos of rows a_key, w, others (array of key, u)."""
    kind = f"array<struct<key:{_key_type(rows)},u:double>>"
    own = F.array(F.struct(F.lit(None).alias("key"), F.col("w").alias("u"))).cast(kind)
    pairs = rows.select(a_key, "w", F.inline(F.concat(own, F.coalesce("others", F.array().cast(kind)))))
    sums = pairs.groupBy(a_key, "key").agg(F.sum(F.col("w") * F.col("u")).alias("s"))
    # per key of a: its square, and a product per key of b
    per = sums.groupBy(a_key).agg(F.max(F.when(F.col("key").isNull(), F.col("s"))).alias("square"), F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "s"))).alias("all"))
    each = per.select(a_key, F.sqrt("square").alias("na"), F.inline("all"))
    return each.select(a_key, F.col("key").alias(b_key), F.coalesce(F.try_divide("s", "na"), F.lit(0.0)).alias("cos"))


def _key_type(rows: DataFrame) -> str:
    return rows.schema["others"].dataType.elementType["key"].dataType.simpleString()
