"""What happens to a document as a whole: each change gives all tables that follow from it.

Nothing is written here; the caller stores the new tables, and moves or removes the files that are named.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators import catalog, search

Index = tuple[DataFrame, DataFrame]


class Library(NamedTuple):
    """docs; document_tags and tags; profile (folder_id, term, count); df (term, df); the search index (see search.build_index)."""

    docs: DataFrame
    document_tags: DataFrame
    tags: DataFrame
    profile: DataFrame
    df: DataFrame
    index: Index


def with_tag_names(docs: DataFrame, document_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """docs with the column tags that the index reads: the names of each document, joined by blanks."""
    named = catalog.tags_of(document_tags, tags).select(F.col("document_id").alias("id"), F.array_join("tags", " ").alias("tags"))
    return docs.drop("tags").join(named, "id", "left")


def _indexed(library: Library, docs: DataFrame, ids: DataFrame) -> Index:
    changed = with_tag_names(docs.join(ids, "id", "left_semi"), library.document_tags, library.tags)
    return search.upserted_index(library.index, changed)


def _moved(before: DataFrame, after: DataFrame, folders: DataFrame) -> DataFrame:
    """id, old, new: files whose place changes; old is null for those that were not filed before."""
    old = catalog.filing_paths(before, folders).withColumnRenamed("path", "old")
    new = catalog.filing_paths(after, folders).withColumnRenamed("path", "new")
    return new.join(old, "id", "left").where(~F.col("old").eqNullSafe(F.col("new"))).select("id", "old", "new")


def update(library: Library, patch: DataFrame, folders: DataFrame) -> tuple[Library, DataFrame, DataFrame]:
    """The library after patch (see catalog.patched), the files that move, and id, error of the rows that were refused."""
    out = catalog.patched(library.docs, patch)
    docs, errors = out.drop("error"), out.where("error IS NOT NULL").select("id", "error")
    ids = patch.select("id").join(errors, "id", "left_anti")
    return library._replace(docs=docs, index=_indexed(library, docs, ids)), _moved(library.docs, docs, folders), errors


def file(library: Library, moves: DataFrame, folders: DataFrame) -> tuple[Library, DataFrame]:
    """The library after documents were filed or filed anew (moves: id, folder_id): folders learn and forget; and the files that move."""
    docs, profile = catalog.refiled(library.docs, moves, library.profile)
    return library._replace(docs=docs, profile=profile, index=_indexed(library, docs, moves.select("id"))), _moved(library.docs, docs, folders)


def delete(library: Library, ids: DataFrame, folders: DataFrame) -> tuple[Library, DataFrame, DataFrame]:
    """The library without the documents ids (id): their folders forget them, frequencies, tags and index rows go; the files to remove; the directories left empty, deepest first."""
    docs, bridge, tags = catalog.deleted(library.docs, library.document_tags, library.tags, ids)
    profile, df = catalog.unlearned(library.docs, ids, library.profile, library.df)
    paths = catalog.filing_paths(library.docs, folders)
    files = paths.join(ids, "id", "left_semi")
    emptied = catalog.emptied_directories(paths.select("path"), paths.join(ids, "id", "left_anti").select("path"))
    return Library(docs, bridge, tags, profile, df, search.dropped_from_index(library.index, ids)), files, emptied
