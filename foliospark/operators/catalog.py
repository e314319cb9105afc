"""The document catalogue: filters, lists, tags, statistics, changes, file names, duplicates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import folders as tree
from foliospark.operators import terms

INBOX, FILED = "eingang", "abgelegt"
# Fixed value: the directory of what is not filed yet.
INBOX_DIR = "Eingang"
HEAVY_COLUMNS = ("text", "sha256", "suggestion")


def find(docs: DataFrame, status: str | None = None, subtree_ids: DataFrame | None = None, tag: str | None = None, document_tags: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame:
    """docs under all given conditions. subtree_ids: id; document_tags: document_id, tag_id; tags: id, name."""
    out = docs
    if status is not None:
        out = out.where(F.col("status") == status)
    if subtree_ids is not None:
        out = out.join(subtree_ids.select(F.col("id").alias("folder_id")), "folder_id", "left_semi")
    if tag is not None:
        named = tags.where(F.lower("name") == tag.lower()).select(F.col("id").alias("tag_id"))
        having = document_tags.join(named, "tag_id", "left_semi").select(F.col("document_id").alias("id"))
        out = out.join(having, "id", "left_semi")
    return out


def by_id(docs: DataFrame, id: int) -> DataFrame:
    """The document with that id, or none; the filter reaches the scan."""
    return docs.where(F.col("id") == F.lit(id))


def by_hash(docs: DataFrame, sha256: str) -> DataFrame:
    """The documents with that content."""
    return docs.where(F.col("sha256") == sha256)


def original_file(docs: DataFrame, id: int) -> DataFrame:
    """file_path and original_name of a document: what a download is made of."""
    return by_id(docs, id).select("file_path", "original_name")


def nocase(name: Column) -> Column:
    """What names are ordered by: A-Z as a-z, all other letters by their code (umlauts behind z)."""
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def light(docs: DataFrame) -> DataFrame:
    """docs without the columns that lists don't show."""
    return docs.drop(*HEAVY_COLUMNS)


def stats(docs: DataFrame) -> DataFrame:
    """One row of counts and sizes, in one pass."""
    stored = F.coalesce("stored_size", "size")
    zero = F.lit(0).cast("long")
    return docs.agg(
        F.count_if(F.col("status") == INBOX).alias("inbox"),
        F.count_if(F.col("status") == FILED).alias("filed"),
        F.coalesce(F.sum("size"), zero).alias("bytes_original"),
        F.coalesce(F.sum(stored), zero).alias("bytes_stored"),
        F.count_if(F.col("stored_size").isNull()).alias("optimize_pending"),
        F.coalesce(F.round((1 - F.try_divide(F.sum(stored), F.sum("size"))) * 100), F.lit(0.0)).alias("saved_percent"),
    )


def filed_counts(docs: DataFrame) -> DataFrame:
    filed = docs.where((F.col("status") == FILED) & F.col("folder_id").isNotNull())
    return filed.groupBy("folder_id").agg(F.count(F.lit(1)).alias("filed"))


def optimize_pending(docs: DataFrame) -> DataFrame:
    return docs.where("stored_size IS NULL").select("id", "size")


def distinct_senders(docs: DataFrame) -> DataFrame:
    return docs.where((F.col("status") == FILED) & F.col("correspondent").isNotNull()).select("correspondent").distinct()


# --------------------------------------------------------------------------- tags


def tags_of(document_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """document_id, tags: the names in order, without regard to case."""
    named = document_tags.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    pair = F.struct(nocase(F.col("name")).alias("k"), F.col("name").alias("n"))
    return named.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["n"]).alias("tags"))


def tag_counts(document_tags: DataFrame, tags: DataFrame, top: int | None = None) -> DataFrame:
    """id, name, count: the most frequent first, then by name; the first top of them, if given."""
    counts = document_tags.groupBy("tag_id").agg(F.count(F.lit(1)).alias("count"))
    out = counts.join(tags, F.col("tag_id") == F.col("id")).select("id", "name", "count").orderBy(F.desc("count"), nocase(F.col("name")), "id")
    return out if top is None else out.limit(top)


def card_tags(tagged: DataFrame, top: int = 6) -> DataFrame:
    """document_id, tags (the first top), more (how many are not shown) of document_id, tags (an array in order)."""
    return tagged.select("document_id", F.slice("tags", 1, top).alias("tags"), F.greatest(F.size("tags") - top, F.lit(0)).alias("more"))


def tag_rows(named: DataFrame, tags: DataFrame, document_tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tags and document_tags after document_id, name of named were inserted or, if they are there, ignored.

    named has one spelling per name (see normalise_tags). New tags get ids above all given ones, in no order and with gaps.
    """
    fresh = named.select("name").distinct().join(tags.select("name"), "name", "left_anti")
    top = tags.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = fresh.crossJoin(F.broadcast(top)).select((F.col("top") + 1 + F.monotonically_increasing_id()).alias("id"), "name")
    every = tags.select("id", "name").unionByName(numbered)
    pairs = named.join(every.withColumnRenamed("id", "tag_id"), "name").select("document_id", "tag_id").distinct()
    return every, document_tags.unionByName(pairs.join(document_tags, ["document_id", "tag_id"], "left_anti"))


def orphan_tags(document_tags: DataFrame, tags: DataFrame) -> DataFrame:
    return tags.join(document_tags.select(F.col("tag_id").alias("id")), "id", "left_anti")


def normalise_tags(raw: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """document_id, pos, name: cleaned tags, the first of each spelling regardless of case; a known spelling wins.

    raw: document_id, pos, name. known: name.
    """
    rows = raw.withColumn("name", T.tag_name(F.col("name"))).where("name <> ''").withColumn("key", F.lower("name"))
    first = rows.groupBy("document_id", "key").agg(F.min(F.struct("pos", "name")).alias("m"))
    rows = first.select("document_id", "key", "m.pos", "m.name")
    if known is not None:
        have = known.groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("kept"))
        rows = rows.join(have, "key", "left").withColumn("name", F.coalesce("kept", "name")).drop("kept")
    return rows.select("document_id", "pos", "name")


# --------------------------------------------------------------------------- changes


def patched(docs: DataFrame, patch: DataFrame) -> DataFrame:
    """docs with the fields of patch (id, title, doc_date, amount, notes as text) where they are given and valid.

    error says what was wrong; such a row keeps its values. Amounts may have a decimal comma.
    """
    p = patch.select("id", *[F.trim(c).alias(f"new_{c}") for c in ("title", "doc_date", "amount", "notes")])
    both = docs.join(p, "id", "left")
    amount = F.try_to_number(F.replace("new_amount", F.lit(","), F.lit(".")), F.lit("999999999999999.999999"))
    amount = F.coalesce(F.replace("new_amount", F.lit(","), F.lit(".")).try_cast("double"), amount.cast("double"))
    # fixed values: the messages
    error = (
        F.when(F.col("new_title") == "", "Titel darf nicht leer sein")
        .when((F.col("new_doc_date") != "") & (~F.col("new_doc_date").rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_date("new_doc_date", "yyyy-MM-dd").isNull()), "Datum bitte als JJJJ-MM-TT")
        .when((F.col("new_amount") != "") & amount.isNull(), "Betrag ist keine Zahl")
    )
    ok = error.isNull()
    pick = lambda new, given, old: F.when(ok & given.isNotNull(), new).otherwise(F.col(old)).alias(old)
    changed = {
        "title": pick(F.col("new_title"), F.col("new_title"), "title"),
        "doc_date": pick(F.try_to_date("new_doc_date", "yyyy-MM-dd"), F.col("new_doc_date"), "doc_date"),
        "amount": pick(amount, F.col("new_amount"), "amount"),
        "notes": pick(F.col("new_notes"), F.col("new_notes"), "notes"),
    }
    return both.select(*[changed.get(c, F.col(c)) for c in docs.columns], error.alias("error"))


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by order; new wins ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(key).orderBy(F.col(order).desc(), F.col("_new").desc())
    return both.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "_new")


def setting(settings: DataFrame, key: str) -> DataFrame:
    """key, value of one setting (settings: one row per key, see upserted); none if it isn't set."""
    return settings.where(F.col("key") == key).select("key", "value")


def inserted(docs: DataFrame, new: DataFrame, key: str = "sha256") -> DataFrame:
    """docs and those of new whose content is new; of equal contents in new the first by name.

    Ids are above all given ones, with gaps: each partition numbers its own rows.
    """
    fresh = new.join(docs.select(key), key, "left_anti")
    fresh = fresh.groupBy(key).agg(F.min(F.struct("original_name", *[c for c in new.columns if c not in (key, "original_name")])).alias("r")).select(key, "r.*")
    top = docs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = fresh.crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + 1 + F.monotonically_increasing_id()).drop("top")
    return docs.unionByName(numbered, allowMissingColumns=True)


def deleted(docs: DataFrame, document_tags: DataFrame, tags: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs, document_tags and tags without the documents ids (id) and the tags that no document has any more."""
    rest = docs.join(ids, "id", "left_anti")
    bridge = document_tags.join(ids.select(F.col("id").alias("document_id")), "document_id", "left_anti")
    return rest, bridge, tags.join(bridge.select(F.col("tag_id").alias("id")), "id", "left_semi")


def unlearned(docs: DataFrame, ids: DataFrame, profile: DataFrame, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folder profiles (folder_id, term, count) and document frequencies (term, df) after the documents ids (id) of docs are gone.

    Only their own words are counted; a filed one is forgotten by its folder, and what falls to 0 goes.
    """
    gone = docs.join(ids, "id", "left_semi")
    tf = terms.term_frequency(gone, "id", "text")
    filed = gone.where((F.col("status") == FILED) & F.col("folder_id").isNotNull()).select("id", "folder_id")
    lost = terms.folder_terms(tf, filed, "id").withColumn("count", -F.col("count"))
    fewer = terms.document_frequency(tf).withColumn("df", -F.col("df"))
    return terms.apply_delta(profile, lost), terms.apply_delta(df, fewer, ("term",), "df")


def refiled(docs: DataFrame, moves: DataFrame, profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs after moves (id, folder_id) were confirmed, and the folder profiles: the old folder of a filed document forgets its words, the new one learns them."""
    to = moves.select("id", F.col("folder_id").alias("_to"))
    moved = docs.join(to, "id")
    tf = terms.term_frequency(moved, "id", "text")
    old = moved.where((F.col("status") == FILED) & F.col("folder_id").isNotNull()).select("id", "folder_id")
    lost = terms.folder_terms(tf, old, "id").withColumn("count", -F.col("count"))
    won = terms.folder_terms(tf, moved.select("id", F.col("_to").alias("folder_id")), "id")
    both = docs.join(to, "id", "left")
    new = {"status": F.when(F.col("_to").isNotNull(), FILED).otherwise(F.col("status")).alias("status"), "folder_id": F.coalesce("_to", "folder_id").alias("folder_id")}
    return both.select(*[new.get(c, F.col(c)) for c in docs.columns]), terms.apply_delta(profile, lost.unionByName(won))


def exact_duplicates(docs: DataFrame, content: str = "text") -> DataFrame:
    """id, sha256, original_id of the documents whose content an earlier one (smaller id) has."""
    hashed = docs.select("id", F.sha2(F.coalesce(content, F.lit("")), 256).alias("sha256"))
    first = hashed.groupBy("sha256").agg(F.min("id").alias("original_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return hashed.join(first, "sha256").where("id <> original_id").select("id", "sha256", "original_id")


# --------------------------------------------------------------------------- files


def folder_directories(folders: DataFrame) -> DataFrame:
    """id, dir: the folder's path with names that file systems accept."""
    safe = folders.withColumn("name", T.safe_filename(F.col("name")))
    return tree.folder_paths(safe).select("id", F.replace("path", F.lit(" / "), F.lit("/")).alias("dir"))


def extension(name: Column) -> Column:
    """The last ending of a file name, lower-cased, with its dot; '' if there is none."""
    return F.lower(F.regexp_extract(name, r"[^/.](\.[^./\s]+)$", 1))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (id, dir, stem, ext) with no: '', or ' (2)', ' (3)', ... in the order of ids, so that no two paths are equal.

    Titles that end with such a number themselves can stand where a numbered one would go. The rows of a directory with
    the same title but for such ends are placed one after another then, each at the first free number; all others are numbered by their rank.
    """
    rows = rows.withColumn("_base", F.regexp_replace("stem", r"( \(\d+\))+$", ""))
    odd = rows.where(F.col("_base") != F.col("stem")).select("dir", "_base", "ext").distinct()
    plain = rows.join(odd, ["dir", "_base", "ext"], "left_anti")
    k = F.row_number().over(Window.partitionBy("dir", "stem", "ext").orderBy("id"))
    plain = plain.withColumn("no", F.when(k > 1, F.concat(F.lit(" ("), k.cast("string"), F.lit(")"))).otherwise(""))
    close = rows.join(odd, ["dir", "_base", "ext"], "left_semi")

    def place(group: pd.DataFrame) -> pd.DataFrame:
        taken, following, out = set(), {}, []
        for stem in group.sort_values("id")["stem"]:
            n, name = following.get(stem, 1), ""
            while True:
                name = "" if n == 1 else f" ({n})"
                n += 1
                if stem + name not in taken:
                    break
            following[stem] = n
            taken.add(stem + name)
            out.append(name)
        return group.sort_values("id").assign(no=out)[["id", "dir", "stem", "ext", "no"]]

    placed = close.groupBy("dir", "_base", "ext").applyInPandas(place, "id long, dir string, stem string, ext string, no string")
    return plain.select("id", "dir", "stem", "ext", "no").unionByName(placed)


def filing_paths(docs: DataFrame, folders: DataFrame) -> DataFrame:
    """id, path: folder/day_title.ext of the filed documents; where that is taken, ' (2)', ' (3)' ... by id, up to the first free one."""
    rows = docs.where((F.col("status") == FILED) & F.col("folder_id").isNotNull())
    day = F.coalesce(F.col("doc_date").cast("string"), F.substring(F.col("created_at").cast("string"), 1, 10))
    rows = rows.select("id", "folder_id", F.concat(day, F.lit("_"), T.safe_filename(F.col("title"), 100)).alias("stem"), extension(F.col("original_name")).alias("ext"))
    rows = rows.join(folder_directories(folders).withColumnRenamed("id", "folder_id"), "folder_id")
    return _numbered(rows.select("id", "dir", "stem", "ext")).select("id", F.concat("dir", F.lit("/"), "stem", "no", "ext").alias("path"))


def moved_files(docs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """id, old, new of the filed documents whose path changes as folders change from before to after (renamed or moved)."""
    old = filing_paths(docs, before).withColumnRenamed("path", "old")
    new = filing_paths(docs, after).withColumnRenamed("path", "new")
    return old.join(new, "id").where("old <> new")


def emptied_directories(before: DataFrame, after: DataFrame, keep: tuple[str, ...] = (INBOX_DIR,)) -> DataFrame:
    """path, depth of the directories that had files (before: path of each) and have none below any more, the deepest first."""

    def parents(files: DataFrame) -> DataFrame:
        parts = F.split("path", "/")
        every = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
        return files.where(F.contains("path", F.lit("/"))).select(F.explode(every).alias("path")).distinct()

    gone = parents(before).join(parents(after), "path", "left_anti").where(~F.col("path").isin(*keep))
    return gone.withColumn("depth", F.size(F.split("path", "/"))).orderBy(F.desc("depth"), "path")


def as_json(docs: DataFrame, folders: DataFrame, tagged: DataFrame, suggestions: DataFrame | None = None) -> DataFrame:
    """id, json: a document as a client gets it: its light columns, tags, folder path, warnings as a list, and suggestions of folders that still exist.

    tagged: document_id, tags. suggestions: doc_id, pos, folder_id, path, score.
    """
    paths = tree.folder_paths(folders).select(F.col("id").alias("folder_id"), F.col("path").alias("folder_path"))
    out = light(docs).join(F.broadcast(paths), "folder_id", "left").join(tagged.select(F.col("document_id").alias("id"), F.col("tags").alias("_tags")), "id", "left")
    out = out.withColumn("tags", F.coalesce("_tags", F.array().cast("array<string>"))).drop("_tags")
    if "warnings" in docs.columns:
        out = out.withColumn("warnings", F.filter(F.split(F.coalesce("warnings", F.lit("")), "\n"), lambda w: w != ""))
    if suggestions is not None:
        one = F.struct("pos", "folder_id", "path", "score")
        per = refreshed_suggestions(suggestions, folders).groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("_all"))
        out = out.join(per, "id", "left")
        shown = F.transform("_all", lambda s: F.struct(s["folder_id"].alias("folder_id"), s["path"].alias("path"), s["score"].alias("score")))
        out = out.withColumn("suggestion", F.coalesce(shown, F.array().cast("array<struct<folder_id:bigint,path:string,score:double>>"))).drop("_all")
    return out.select("id", F.to_json(F.struct(*[c for c in out.columns])).alias("json"))


def offered(suggestions: DataFrame, least: float = 0.15) -> DataFrame:
    """The suggestions that a client shows: the first of each document, and further ones from a score of least on."""
    first = Window.partitionBy("doc_id").orderBy("pos")
    return suggestions.withColumn("_k", F.row_number().over(first)).where((F.col("_k") == 1) | (F.col("score") >= least)).drop("_k")


def refreshed_suggestions(suggestions: DataFrame, folders: DataFrame) -> DataFrame:
    """suggestions (doc_id, pos, folder_id, path, score) of folders that still exist, with their present path."""
    paths = tree.folder_paths(folders).select(F.col("id").alias("folder_id"), F.col("path").alias("now"))
    return suggestions.join(paths, "folder_id").select("doc_id", "pos", "folder_id", F.col("now").alias("path"), "score")
