"""Polled import as a stream: new files of a landing folder, deduplicated against the store, read and analysed.

The checkpoint remembers which files were read, so runs never overlap, and a second start for the same store is refused while one is active;
contents that came before are rejected by their hash, which makes the at-least-once delivery of a retried batch effectively once. Every
batch writes to folders of its own: documents with what their text says, their tags and suggestions, the changes of the document
frequencies, rejects with a reason, and a summary. Imported files are moved to an archive folder if one is given; rejects stay.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark.operators import catalog, classify, metadata, terms
from foliospark.sources import files as source

MIN_MINUTES, MAX_MINUTES, DEFAULT_MINUTES = 1, 1440, 10
MAX_FILES = 1000
STORE_SCHEMA = (
    "path string, sha256 string, size long, text string, pages int, method string, warnings array<string>, title string, doc_type string, "
    "doc_date date, amount double, iban string, correspondent string, keywords array<string>, batch long"
)
HASH_SCHEMA = "sha256 string, batch long, prefix string"
TAG_SCHEMA = "sha256 string, pos int, name string, batch long"
DF_SCHEMA = "term string, df long, batch long"
SUGGESTION_SCHEMA = "sha256 string, pos long, folder_id long, path string, score double, batch long"
REJECT_SCHEMA = "path string, sha256 string, error string, batch long"
SUMMARY_SCHEMA = "batch long, imported long, duplicates long, errors long"


def read_table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table of the store; empty before the first run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(f"{folder}/{name}") if there else spark.createDataFrame([], schema)


def _replace_batch(df: DataFrame, folder: str, name: str, batch: int, by: tuple[str, ...] = ()) -> None:
    """Writes a batch's rows to a folder of its own: a batch that is run again replaces what it wrote."""
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/{name}/batch={batch}")


def _prefix() -> Column:
    return F.substring("sha256", 1, 2)


def stem(path: Column) -> Column:
    """A file's name without its folders and its ending."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=[^.])\.[^.]+$", "")


def document_frequency(spark: SparkSession, store: str, batch: int | None = None) -> DataFrame:
    """term, df of the store, without what the batch itself wrote."""
    changes = read_table(spark, store, "term_df", DF_SCHEMA)
    changes = changes if batch is None else changes.where(F.col("batch") != batch)
    return changes.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


def import_batch(batch_df: DataFrame, batch: int, store: str, as_of_year: int = 2100, folders: DataFrame | None = None, filed: DataFrame | None = None, archive: str | None = None) -> None:
    """folders, filed (doc_id, text, folder_id, correspondent): what suggestions and known senders are made of; without them there are none."""
    spark = batch_df.sparkSession
    hashed = batch_df.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), "content")
    # only the prefixes of this batch are read, at most 256
    prefixes = [r["p"] for r in hashed.select(_prefix().alias("p")).distinct().collect()]
    known = read_table(spark, store, "hashes", HASH_SCHEMA).where((F.col("batch") != batch) & F.col("prefix").isin(prefixes))
    accepted, rejected = source.gate(hashed, known)
    _replace_batch(source.extract_files(accepted), store, "texts", batch)
    rows = spark.read.parquet(f"{store}/texts/batch={batch}")  # read and parsed once

    n = read_table(spark, store, "documents", STORE_SCHEMA).where(F.col("batch") != batch).agg(F.count(F.lit(1)).alias("n"))
    senders = (filed if filed is not None else spark.createDataFrame([], "correspondent string")).where("correspondent IS NOT NULL").select(F.col("correspondent").alias("name")).distinct()
    named = rows.withColumn("title", stem(F.col("path")))
    info = metadata.analyse(named, document_frequency(spark, store, batch), n, senders, as_of_year, "sha256").withColumn("title", F.col("suggested_title"))
    _replace_batch(info.select(*[c.split()[0] for c in STORE_SCHEMA.split(", ") if not c.startswith("batch")]), store, "documents", batch)
    written = read_table(spark, store, "documents", STORE_SCHEMA).where(F.col("batch") == batch)

    raw = written.select(F.col("sha256").alias("document_id"), F.posexplode(F.concat(F.array_compact(F.array("doc_type")), F.coalesce("keywords", F.array().cast("array<string>")))).alias("pos", "name"))
    _replace_batch(catalog.normalise_tags(raw).select(F.col("document_id").alias("sha256"), "pos", "name"), store, "tags", batch)
    tf = terms.term_frequency(written, "sha256")
    _replace_batch(terms.document_frequency(tf), store, "term_df", batch)
    if folders is not None:
        docs = written.select(F.col("sha256").alias("doc_id"), "text", "correspondent")
        hits = classify.rule_hits(docs, folders)
        rules = classify.inherited_weights(classify.own_weights(hits, folders), folders)
        at = filed if filed is not None else spark.createDataFrame([], "doc_id string, text string, folder_id long, correspondent string")
        at = at.withColumn("doc_id", F.col("doc_id").cast("string"))
        learned = classify.learned_scores(docs, at.select("doc_id", "folder_id"), at.select("doc_id", "text"))
        scores = classify.folder_scores(rules, learned, classify.sender_votes(docs, at))
        out = classify.suggestions(scores, folders, docs)
        _replace_batch(out.withColumnRenamed("doc_id", "sha256"), store, "suggestions", batch)

    _replace_batch(rejected, store, "rejects", batch)
    refused = read_table(spark, store, "rejects", REJECT_SCHEMA).where(F.col("batch") == batch)
    again = F.col("error") == "bereits vorhanden"
    counts = refused.agg(F.count_if(again).alias("duplicates"), F.count_if(~again).alias("errors"))
    summary = written.agg(F.count(F.lit(1)).alias("imported")).crossJoin(counts)  # one row each
    _replace_batch(summary, store, "summary", batch)
    _replace_batch(written.select("sha256", _prefix().alias("prefix")), store, "hashes", batch, ("prefix",))
    if archive is not None:
        archive_files(written.select("path"), archive)


def archive_files(paths: DataFrame, archive: str) -> None:
    """Moves imported files (path), at most MAX_FILES of a batch, to the archive folder; one that is gone already is passed over."""
    spark = paths.sparkSession
    conf, Path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    target = Path(archive)
    system = target.getFileSystem(conf)
    system.mkdirs(target)
    for r in paths.toLocalIterator():
        old = Path(r["path"])
        name = old.getName()
        if system.exists(Path(target, name)):
            name = hashlib.sha256(r["path"].encode()).hexdigest()[:12] + "_" + name
        if system.exists(old):
            system.rename(old, Path(target, name))


def start_import(spark: SparkSession, landing: str, store: str, minutes: int | None = None, archive: str | None = None, **analysis) -> StreamingQuery:
    """Imports what is new and ends (minutes None), or goes on every so many minutes (1 to 1440). Refuses to start while an import to the same store runs.

    analysis: further arguments of import_batch.
    """
    name = "import-" + hashlib.sha256(store.encode()).hexdigest()[:16]
    if any(q.name == name for q in spark.streams.active):
        raise RuntimeError("an import to this store is running")
    stream = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", MAX_FILES)
        .load(landing)
    )
    writer = stream.writeStream.queryName(name).foreachBatch(lambda df, batch: import_batch(df, batch, store, archive=archive, **analysis)).option("checkpointLocation", f"{store}/_checkpoint")
    if minutes is None:
        return writer.trigger(availableNow=True).start()
    every = max(MIN_MINUTES, min(MAX_MINUTES, minutes))
    return writer.trigger(processingTime=f"{every} minutes").start()


def summaries(spark: SparkSession, store: str) -> DataFrame:
    return read_table(spark, store, "summary", SUMMARY_SCHEMA)
