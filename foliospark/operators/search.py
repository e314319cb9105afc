"""Full-text prefix search ranked with BM25, the index it can use, and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as T

K1, B = 1.2, 0.75
FIELDS = ("title", "correspondent", "tags", "text")
LIST_LIMIT = 200


def field_tokens(fields: tuple[str, ...] = FIELDS) -> Column:
    return F.flatten(F.array(*[T.words(T.fold(F.coalesce(F.col(f), F.lit("")))) for f in fields]))


def build_index(docs: DataFrame, doc: str = "id", fields: tuple[str, ...] = FIELDS) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths): term, doc, tf; and doc, doc_len of all documents, those without a word too."""
    rows = docs.select(doc, field_tokens(fields).alias("tokens"))
    postings = rows.select(doc, F.explode("tokens").alias("term")).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))
    return postings.select("term", doc, "tf"), rows.select(doc, F.size("tokens").alias("doc_len"))


def write_index(index: tuple[DataFrame, DataFrame], folder: str) -> None:
    """Stores an index; postings in ranges of terms, sorted, so that a prefix reads few row groups."""
    postings, lengths = index
    postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/postings")
    lengths.write.mode("overwrite").parquet(f"{folder}/lengths")


def read_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/lengths")


def upserted_index(index: tuple[DataFrame, DataFrame], changed: DataFrame, doc: str = "id", fields: tuple[str, ...] = FIELDS) -> tuple[DataFrame, DataFrame]:
    """The index with the documents changed deleted and put in anew; the others' rows are not computed again."""
    return tuple(o.join(changed.select(doc), doc, "left_anti").unionByName(n) for o, n in zip(index, build_index(changed, doc, fields)))


def dropped_from_index(index: tuple[DataFrame, DataFrame], gone: DataFrame, doc: str = "id") -> tuple[DataFrame, DataFrame]:
    """The index without the documents gone (doc)."""
    return tuple(o.join(gone.select(doc), doc, "left_anti") for o in index)


def _rank(hits: DataFrame, stats: DataFrame, n_terms: int) -> DataFrame:
    """score over the columns f0 .. (prefix hits) and len; stats: one row, n, avglen, n0 .."""
    score = F.lit(0.0)
    for i in range(n_terms):
        f = F.col(f"f{i}")
        weight = F.ln((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        weight = F.when(weight <= 0, F.lit(1e-6)).otherwise(weight)
        score = score - weight * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avglen")))
    return hits.crossJoin(F.broadcast(stats)).withColumn("score", score)  # one row of statistics


def bm25(docs: DataFrame, query: str, doc: str = "id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """docs that have all prefixes of the query, with score (lower is better).

    One scan without a shuffle of rows: hits per prefix are counted within the row, only the statistics (rows,
    mean length, rows per prefix) are aggregated and sent back as one row. A query without a word gives docs unranked.
    """
    prefixes = T.prefix_terms(query)
    if not prefixes:
        return docs.withColumn("score", F.lit(0.0))

    def hits_of(prefix: str) -> Column:
        return F.size(F.filter("_tokens", lambda t: F.startswith(t, F.lit(prefix))))

    rows = docs.withColumn("_tokens", field_tokens(fields))
    counted = rows.withColumns(
        {"len": F.size("_tokens"), **{f"f{i}": hits_of(p) for i, p in enumerate(prefixes)}}
    ).drop("_tokens")
    stats = counted.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("len").alias("avglen"),
        *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(prefixes))],
    )
    hits = counted
    for i in range(len(prefixes)):
        hits = hits.where(F.col(f"f{i}") > 0)
    return _rank(hits, stats, len(prefixes)).select(*docs.columns, "score")


def bm25_indexed(index: tuple[DataFrame, DataFrame], query: str, doc: str = "id") -> DataFrame:
    """doc, score out of an index: postings are read once, those of the prefixes only. A query without a word lists all documents, unranked."""
    postings, lengths = index
    prefixes = T.prefix_terms(query)
    if not prefixes:
        return lengths.select(doc, F.lit(0.0).alias("score"))
    starts = [F.startswith("term", F.lit(p)) for p in prefixes]
    wanted = starts[0]
    for s in starts[1:]:
        wanted = wanted | s
    # hits of each prefix per document, in one grouping
    per = postings.where(wanted).groupBy(doc).agg(*[F.coalesce(F.sum(F.when(s, F.col("tf"))), F.lit(0)).alias(f"f{i}") for i, s in enumerate(starts)])
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("avglen"))
    stats = stats.crossJoin(per.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(prefixes))]))  # one row each
    hits = per.where(" AND ".join(f"f{i} > 0" for i in range(len(prefixes)))).join(lengths.withColumnRenamed("doc_len", "len"), doc)
    return _rank(hits, stats, len(prefixes)).select(doc, "score")


def recent_first(docs: DataFrame, limit: int = LIST_LIMIT, ranked: bool = False) -> DataFrame:
    """The first rows by score (if ranked), day (doc_date or created) descending and id descending."""
    day = F.coalesce(F.col("doc_date").cast("string"), F.substring(F.col("created_at").cast("string"), 1, 10))
    keys = [F.round("score", 6).asc()] if ranked else []
    return docs.orderBy(*keys, day.desc(), F.col("id").desc()).limit(limit)


def snippet(text: Column, query: str, size: int = 14, mark: tuple[str, str] = ("\x01", "\x02"), gap: str = "…") -> Column:
    """The size words around the most hits (first such place), hits marked; the start of the text if there is none."""
    prefixes = T.prefix_terms(query)

    def is_hit(word: Column) -> Column:
        out = F.lit(False)
        for p in prefixes:
            out = out | F.startswith(word, F.lit(p))
        return out

    def window(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(v["t"]) - size, F.lit(0)))
        hits = F.transform(starts, lambda s: F.struct(F.size(F.filter(F.slice(v["hit"], s + 1, F.lit(size)), lambda f: f)).alias("n"), (-s).alias("at")))
        return F.struct(v["t"].alias("t"), v["hit"].alias("hit"), (-F.array_max(hits)["at"]).alias("at"))

    def shown(v: Column) -> Column:
        pairs = F.arrays_zip(F.slice(v["t"], v["at"] + 1, F.lit(size)).alias("t"), F.slice(v["hit"], v["at"] + 1, F.lit(size)).alias("f"))
        marked = F.transform(pairs, lambda z: F.when(z["f"], F.concat(F.lit(mark[0]), z["t"], F.lit(mark[1]))).otherwise(z["t"]))
        return F.concat(F.when(v["at"] > 0, gap).otherwise(""), F.array_join(marked, " "), F.when(v["at"] + size < F.size(v["t"]), gap).otherwise(""))

    tokens = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    flagged = T.let(tokens, lambda t: F.struct(t.alias("t"), F.transform(t, lambda w: F.exists(T.words(T.fold(w)), is_hit)).alias("hit")))
    return T.let(T.let(flagged, window), shown)
