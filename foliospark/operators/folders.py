"""Folder trees: paths, closure, roll-ups, guards, outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.functions.reference_data import DEFAULT_FOLDERS

MAX_DEPTH = 100


def seed_folders(spark: SparkSession, tree: list = DEFAULT_FOLDERS) -> DataFrame:
    """The first folders: id, parent_id, name, keywords; numbered depth first."""
    rows: list[tuple] = []

    def add(items: list, parent: int | None) -> None:
        for name, keywords, children in items:
            rows.append((len(rows) + 1, parent, name, keywords))
            add(children, rows[-1][0])

    add(tree, None)
    return spark.createDataFrame(rows, "id long, parent_id long, name string, keywords string")


def closure(folders: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """anc, desc, depth for every folder and each of its ancestors, itself included (depth 0).

    A recursive query: Spark evaluates it level by level, each a join on parent_id. Cycles end at max_depth.
    """
    return folders.sparkSession.sql(
        """
        WITH RECURSIVE up(anc, desc, depth) AS (
          SELECT id, id, 0 FROM {folders}
          UNION ALL
          SELECT f.parent_id, up.desc, up.depth + 1 FROM up JOIN {folders} f ON f.id = up.anc
          WHERE f.parent_id IS NOT NULL AND up.depth < {max_depth})
        SELECT anc, desc, depth FROM up
        """,
        folders=folders.select("id", "parent_id"),
        max_depth=int(max_depth),
    )


def folder_paths(folders: DataFrame) -> DataFrame:
    """id, path ('A / B / C'), depth; down to MAX_DEPTH levels. Folders on a cycle have no path."""
    return folders.sparkSession.sql(
        """
        WITH RECURSIVE p(id, path, depth) AS (
          SELECT id, name, 1 FROM {folders} WHERE parent_id IS NULL
          UNION ALL
          SELECT f.id, concat(p.path, ' / ', f.name), p.depth + 1 FROM p JOIN {folders} f ON f.parent_id = p.id WHERE p.depth < {max_depth})
        SELECT id, path, depth FROM p
        """,
        folders=folders.select("id", "parent_id", "name"),
        max_depth=MAX_DEPTH,
    )


def subtree(folders: DataFrame, root: int) -> DataFrame:
    """id of root and everything below; cycles end at MAX_DEPTH."""
    return folders.sparkSession.sql(
        """
        WITH RECURSIVE sub(id, depth) AS (
          SELECT id, 1 FROM {folders} WHERE id = {root}
          UNION ALL SELECT f.id, sub.depth + 1 FROM sub JOIN {folders} f ON f.parent_id = sub.id WHERE sub.depth < {max_depth})
        SELECT DISTINCT id FROM sub
        """,
        folders=folders.select("id", "parent_id"),
        root=int(root),
        max_depth=MAX_DEPTH,
    )


def direct_counts(folders: DataFrame, filed: DataFrame) -> DataFrame:
    """folders with the number of documents filed in each. filed: doc_id, folder_id."""
    counts = filed.groupBy("folder_id").agg(F.count(F.lit(1)).alias("count"))
    joined = folders.join(counts, F.col("id") == F.col("folder_id"), "left").drop("folder_id")
    return joined.withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))


def total_counts(folders: DataFrame, filed: DataFrame) -> DataFrame:
    """id, total: documents in the folder and below."""
    own = direct_counts(folders, filed).select(F.col("id").alias("desc"), "count")
    return closure(folders).join(own, "desc").groupBy(F.col("anc").alias("id")).agg(F.sum("count").alias("total"))


def reparent_check(folders: DataFrame, moves: DataFrame) -> DataFrame:
    """moves (id, new_parent) with ok: a folder must not go below itself."""
    below = closure(folders).select(F.col("anc").alias("id"), F.col("desc").alias("new_parent"), F.lit(True).alias("below"))
    return moves.join(below, ["id", "new_parent"], "left").select("id", "new_parent", F.col("below").isNull().alias("ok"))


def delete_check(folders: DataFrame, filed: DataFrame) -> DataFrame:
    """id, has_children, has_documents, ok: only empty folders without children may be deleted."""
    parents = folders.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct().withColumn("has_children", F.lit(True))
    used = filed.where("folder_id IS NOT NULL").select(F.col("folder_id").alias("id")).distinct().withColumn("has_documents", F.lit(True))
    no = F.lit(False)
    out = folders.select("id").join(parents, "id", "left").join(used, "id", "left")
    out = out.select("id", F.coalesce("has_children", no).alias("has_children"), F.coalesce("has_documents", no).alias("has_documents"))
    return out.withColumn("ok", ~F.col("has_children") & ~F.col("has_documents"))


def name_conflicts(folders: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (parent_id, name) that exist already, names compared without case."""
    here = folders.select(F.coalesce("parent_id", F.lit(0)).alias("p"), F.lower("name").alias("n")).distinct()
    marked = wanted.withColumns({"p": F.coalesce("parent_id", F.lit(0)), "n": F.lower("name")})
    return marked.join(here, ["p", "n"], "left_semi").drop("p", "n")


# --------------------------------------------------------------------------- outlines


def parse_outline(outlines: DataFrame, key: str = "outline_id", text: str = "text") -> DataFrame:
    """key, path (array of names), depth, error of the folders of indented lists.

    A line's parent is the nearest line above with a smaller indent. Folders that differ in case only, under
    the same parent, are one, with the first spelling. error is set on names with a slash.
    """
    lines = outlines.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")).alias("no", "raw"))
    line = F.replace(F.col("raw"), F.lit("\t"), F.lit("    "))
    name = F.regexp_replace(line, r"^\s*(?:[*\-•·–+]|\d+[.)])\s+", "")
    name = T.collapse(F.btrim(F.trim(F.regexp_replace(name, r"^\s+|\s+$", "")), F.lit(":")))
    lines = lines.select(key, "no", (F.length(line) - F.length(F.ltrim(line))).alias("indent"), name.alias("name")).where("name <> ''")
    # outlines are short texts: the lines of one are folded in their order
    rows = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("no", "indent", "name"))).alias("rows"))
    kind = "array<struct<indent:int,name:string>>"
    start = F.struct(F.array().cast(kind).alias("stack"), F.array().cast("array<array<string>>").alias("paths"))

    def step(acc, row):
        above = F.filter(acc["stack"], lambda s: s["indent"] < row["indent"])
        stack = F.concat(above, F.array(F.struct(row["indent"].alias("indent"), row["name"].alias("name"))))
        return F.struct(stack.alias("stack"), F.concat(acc["paths"], F.array(F.transform(stack, lambda s: s["name"]))).alias("paths"))

    paths = rows.select(key, F.posexplode(F.aggregate("rows", start, step)["paths"]).alias("no", "path"))
    lower = F.transform("path", lambda n: F.lower(n))
    first = Window.partitionBy(key, "lower").orderBy("no")
    unique = paths.withColumn("lower", lower).withColumn("k", F.row_number().over(first)).where("k = 1")
    bad = F.exists("path", lambda n: n.contains("/") | n.contains("\\"))
    return unique.select(key, "no", "path", F.size("path").cast("long").alias("depth"), F.when(bad, F.lit("Schrägstrich im Ordnernamen")).alias("error"))


def outline_errors(outlines: DataFrame, key: str = "outline_id", text: str = "text") -> DataFrame:
    """key, error of the outlines that are refused: those without a folder, and those with a slash in a name."""
    parsed = parse_outline(outlines, key, text)
    per = outlines.select(key).join(parsed.groupBy(key).agg(F.max("error").alias("error"), F.count(F.lit(1)).alias("n")), key, "left")
    # fixed value: the message
    return per.select(key, F.when(F.col("n").isNull(), "Die Liste enthält keine Ordner").otherwise(F.col("error")).alias("error")).where("error IS NOT NULL")


def removal_order(diff: DataFrame) -> DataFrame:
    """path, depth of the folders that an outline_diff removes, the deepest first: children before their parents."""
    gone = diff.where("action = 'remove'").select("path", F.size(F.split("path", " / ")).alias("depth"))
    return gone.orderBy(F.desc("depth"), "path")


def outline_diff(wanted: DataFrame, folders: DataFrame, filed: DataFrame, remove_empty: bool = True) -> DataFrame:
    """path, action (create, exists, keep_nonempty, remove, keep), documents, keywords of a wanted structure.

    wanted: path (array of names). Folders are compared by their whole path without case, also below folders
    that don't exist yet.
    """
    here = folder_paths(folders).join(total_counts(folders, filed), "id").select(F.lower("path").alias("key"), F.col("path").alias("old"), "total")
    new = wanted.select(F.array_join("path", " / ").alias("new"), F.element_at("path", -1).alias("name")).withColumn("key", F.lower("new"))
    both = new.join(here, "key", "full_outer")
    action = (
        F.when(F.col("old").isNull(), "create")
        .when(F.col("new").isNotNull(), "exists")
        .when(F.col("total") > 0, "keep_nonempty")
        .otherwise("remove" if remove_empty else "keep")
    )
    return both.select(
        F.coalesce("new", "old").alias("path"), action.alias("action"), F.coalesce("total", F.lit(0)).cast("long").alias("documents"),
        F.when(F.col("old").isNull(), T.suggest_folder_keywords(F.col("name"))).alias("keywords"),
    )
