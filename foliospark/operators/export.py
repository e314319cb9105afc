"""Planning an idempotent export to an external archive: dimensions, pending documents, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.functions.reference_data import DOC_TYPES
from foliospark.operators import catalog
from foliospark.operators import folders as tree


def dimension(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """wanted (name) that the archive doesn't have yet, names compared without case. have: name."""
    here = have.select(F.lower("name").alias("_key")).distinct()
    named = wanted.where("name IS NOT NULL").groupBy(F.lower("name").alias("_key")).agg(F.min("name").alias("name"))
    return named.join(here, "_key", "left_anti").select("name")


def document_types(docs: DataFrame) -> DataFrame:
    """name of all kinds: the known ones and those that documents have."""
    known = docs.sparkSession.createDataFrame([(n,) for n, _ in DOC_TYPES], "name string")
    return known.unionByName(docs.where("doc_type IS NOT NULL").select(F.col("doc_type").alias("name"))).distinct()


def pending(docs: DataFrame, done: DataFrame, include_inbox: bool = True) -> DataFrame:
    """docs that were not exported yet, by id. done: local_id."""
    rows = docs if include_inbox else docs.where(F.col("status") == catalog.FILED)
    return rows.join(done.select(F.col("local_id").alias("id")), "id", "left_anti").orderBy("id")


def storage_paths(folders: DataFrame, double_braces: bool = True) -> DataFrame:
    """folder_id, path, template of the storage paths that the archive needs, by path."""
    paths = tree.folder_paths(folders)
    return paths.select(F.col("id").alias("folder_id"), "path", T.storage_template(F.col("path"), double_braces).alias("template")).orderBy("path")


def payload(docs: DataFrame, storage: DataFrame, types: DataFrame, senders: DataFrame, tagged: DataFrame | None = None, tag_ids: DataFrame | None = None) -> DataFrame:
    """id, title, created, correspondent_id, document_type_id, storage_path_id, tag_ids, inbox, note of each document.

    storage: folder_id, remote_id; types, senders, tag_ids: name, remote_id; tagged: document_id, tags (names in order). Only filed documents get a storage
    path, the others the inbox mark.
    """
    out = docs.join(types.select(F.col("name").alias("doc_type"), F.col("remote_id").alias("document_type_id")), "doc_type", "left")
    out = out.join(senders.select(F.col("name").alias("correspondent"), F.col("remote_id").alias("correspondent_id")), "correspondent", "left")
    out = out.join(storage.select("folder_id", F.col("remote_id").alias("path_id")), "folder_id", "left")
    filed = F.col("status") == catalog.FILED
    created = F.coalesce(F.col("doc_date").cast("string"), F.substring(F.col("created_at").cast("string"), 1, 10))
    note = T.export_note(F.col("notes"), F.col("amount"), F.col("iban"), F.col("id"), F.col("original_name"))
    ids = F.array().cast("array<bigint>")
    if tagged is not None:
        each = tagged.select(F.col("document_id").alias("id"), F.posexplode("tags").alias("pos", "name")).join(tag_ids.select("name", "remote_id"), "name")
        each = each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "remote_id"))), lambda t: t["remote_id"]).alias("_tags"))
        out = out.join(each, "id", "left")
        ids = F.coalesce(F.col("_tags"), ids)
    return out.select(
        "id", "title", created.alias("created"), "correspondent_id", "document_type_id", F.when(filed, F.col("path_id")).alias("storage_path_id"), ids.alias("tag_ids"), (~filed).alias("inbox"), note.alias("note")
    )


def outcomes(results: DataFrame) -> DataFrame:
    """One row: done, skipped (the archive had the content), errors. results: local_id, remote_id, error."""
    duplicate = F.lower("error").contains("duplicate") | F.lower("error").contains("duplikat")
    return results.agg(
        F.count_if(F.col("error").isNull()).alias("done"),
        F.count_if(F.coalesce(duplicate, F.lit(False))).alias("skipped"),
        F.count_if(F.col("error").isNotNull() & ~duplicate).alias("errors"),
    )


def task_document(task: Column) -> Column:
    """The document id in an archive's task report (JSON), whichever version wrote it; null if it has none."""
    # fixed values: where versions put it
    places = ("$.related_document", "$.related_document_ids[0]", "$.result_data.document_id")
    text = F.regexp_extract(F.get_json_object(task, "$.result"), r"(?:id|Id) (\d+)", 1)
    return F.coalesce(*[F.nullif(F.get_json_object(task, p), F.lit("")) for p in places], F.nullif(text, F.lit(""))).try_cast("long")


def task_error(task: Column) -> Column:
    """What a failed task report (JSON) says: the first of its fields that says anything, objects as JSON."""
    # fixed values: the fields, and the message where all are empty
    fields = [F.get_json_object(task, p) for p in ("$.result", "$.result_data", "$.result_message")]
    said = [F.when(~f.isin("", "0", "0.0", "false", "[]", "{}"), f) for f in fields]
    return F.coalesce(*said, F.lit("Verarbeitung im Archiv fehlgeschlagen"))


def substitute_note(original_name: Column) -> Column:
    """What is added to the note if the archive refused the kind of file and got its text as a PDF instead."""
    ending = F.regexp_extract(original_name, r"(\.[^.]*)$", 1)
    return F.concat(F.lit("\nHinweis: Das Archiv nimmt "), ending, F.lit("-Dateien nicht an. Übertragen wurde eine Textfassung als PDF; das Original liegt weiter in der Ablage."))
