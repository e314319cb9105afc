"""The engine's tables, made of the star-schema tables that tests and benchmarks have.

Each binding has its SQL beside it, as common table expressions for the comparison queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is stored. On a laptop (a local master) one of a single row group is dealt to the cores; on a cluster nothing is shuffled for that."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if not spark.sparkContext.master.startswith("local") or name not in TEXT_TABLES or df.rdd.getNumPartitions() > 1:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism)


#: The tables whose rows cost much to read over.
TEXT_TABLES = ("documents", "orders", "pages")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a catalogue: labelled ones count as filed, their source gives folder and sender."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    rows = docs.join(marks, "doc_id", "left")
    number = F.substring("source", 4, 9).cast("long")
    return rows.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("Dokument: "), F.col("lang"), F.lit(" / "), F.col("source")).alias("title"),
        F.concat(F.lit("scan_"), F.col("doc_id").cast("string"), F.lit(".PDF")).alias("original_name"),
        F.when(F.col("toxic").isNotNull(), "abgelegt").otherwise("eingang").alias("status"),
        (number + 100).alias("folder_id"),
        F.concat(F.lit("Müller "), F.col("source")).alias("correspondent"),
        F.col("n_chars").alias("size"),
        F.when(F.coalesce("toxic", F.lit(0)) == 0, F.length(F.trim("text")).cast("long")).alias("stored_size"),
        F.when(F.col("lang") == "en", "Rechnung").when(F.col("lang") == "de", "Vertrag").when(F.col("lang") == "fr", "Quittung mit Nachweis").alias("doc_type"),
        F.when(F.col("quality") == 1, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_chars") % 500).cast("int"))).alias("doc_date"),
        F.date_add(F.lit("2024-06-01").cast("date"), (F.col("doc_id") % 300).cast("int")).alias("created_at"),
        (F.col("n_chars") / 100).alias("amount"),
        F.when(F.col("lang") == "de", "DE89 3704 0044 0532 0130 00").alias("iban"),
        F.when(F.col("toxic") == 1, "bitte prüfen").otherwise("").alias("notes"),
        F.col("lang").alias("tags"),
        "text",
    )


CATALOG = """marks AS (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id),
cat AS (
  SELECT d.doc_id AS id, 'Dokument: ' || lang || ' / ' || source AS title, 'scan_' || d.doc_id || '.PDF' AS original_name,
         CASE WHEN toxic IS NOT NULL THEN 'abgelegt' ELSE 'eingang' END AS status, 100 + CAST(substr(source, 4) AS BIGINT) AS folder_id,
         'Müller ' || source AS correspondent, n_chars AS size, CASE WHEN coalesce(toxic, 0) = 0 THEN length(trim(text, ' ')) END AS stored_size,
         CASE lang WHEN 'en' THEN 'Rechnung' WHEN 'de' THEN 'Vertrag' WHEN 'fr' THEN 'Quittung mit Nachweis' END AS doc_type,
         CASE WHEN quality = 1 THEN DATE '2024-01-01' + CAST(n_chars % 500 AS INTEGER) END AS doc_date,
         DATE '2024-06-01' + CAST(d.doc_id % 300 AS INTEGER) AS created_at, n_chars / 100 AS amount,
         CASE WHEN lang = 'de' THEN 'DE89 3704 0044 0532 0130 00' END AS iban, CASE WHEN toxic = 1 THEN 'bitte prüfen' ELSE '' END AS notes, lang AS tags, text
  FROM documents d LEFT JOIN marks m ON d.doc_id = m.doc_id)"""

#: Keywords that folders get by their number; words and parts of words of the invented languages.
KEYWORD_SETS = ["ation, thing; the", "ererb\nof the", "heiten, und", "menté, que", "ción, las", "in the, inger", "tionth", "ouand, a", "enten, sch", "re"]


def folders(spark: SparkSession, sf_dir: str, suppliers: bool = True) -> DataFrame:
    """region, nation and (if suppliers) supplier as one tree; a root folder for the rest."""
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    sets = F.array(*[F.lit(k) for k in KEYWORD_SETS])

    def words(n):
        return F.get(sets, (n % len(KEYWORD_SETS)).cast("int"))

    none = F.lit(None).cast("long")
    top = region.select((F.col("r_regionkey") + 1).cast("long").alias("id"), none.alias("parent_id"), F.col("r_name").alias("name"), words(F.col("r_regionkey")).alias("keywords"))
    mid = nation.select((F.col("n_nationkey") + 100).cast("long").alias("id"), (F.col("n_regionkey") + 1).cast("long").alias("parent_id"), F.col("n_name").alias("name"), words(F.col("n_nationkey")).alias("keywords"))
    rest = spark.range(1).select(F.lit(99).cast("long").alias("id"), none.alias("parent_id"), F.lit("Sonstiges").alias("name"), F.lit("").alias("keywords"))
    out = top.unionByName(mid).unionByName(rest)
    if suppliers:
        low = supplier.select((F.col("s_suppkey") + 1000).cast("long").alias("id"), (F.col("s_nationkey") + 100).cast("long").alias("parent_id"), F.col("s_name").alias("name"), F.lit("").alias("keywords"))
        out = out.unionByName(low)
    return out


def folders_sql(suppliers: bool = True) -> str:
    sets = "[" + ", ".join("'" + k.replace("\n", "' || chr(10) || '") + "'" for k in KEYWORD_SETS) + "]"
    low = "UNION ALL SELECT CAST(s_suppkey AS BIGINT) + 1000, CAST(s_nationkey AS BIGINT) + 100, s_name, '' FROM supplier" if suppliers else ""
    return f"""fold(id, parent_id, name, keywords) AS (
  SELECT CAST(r_regionkey AS BIGINT) + 1, CAST(NULL AS BIGINT), r_name, ({sets})[r_regionkey % 10 + 1] FROM region
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 100, CAST(n_regionkey AS BIGINT) + 1, n_name, ({sets})[n_nationkey % 10 + 1] FROM nation
  UNION ALL SELECT 99, NULL, 'Sonstiges', '' {low})"""


PATHS = """path(id, path, depth) AS (
  SELECT id, name, 1 FROM fold WHERE parent_id IS NULL
  UNION ALL SELECT f.id, p.path || ' / ' || f.name, p.depth + 1 FROM path p JOIN fold f ON f.parent_id = p.id)"""
CLOSURE = """up(anc, desc_id, depth) AS (
  SELECT id, id, 0 FROM fold
  UNION ALL SELECT f.parent_id, u.desc_id, u.depth + 1 FROM up u JOIN fold f ON f.id = u.anc WHERE f.parent_id IS NOT NULL)"""


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "en"), (2, "de"), (3, "fr"), (4, "es"), (5, "Unbenutzt"), (6, "Lang"), (7, "Älter")]
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).cast("long"), F.lit(n)) for i, n in rows])).alias("id", "name"))


def document_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    by_lang = docs.join(F.broadcast(tags(spark, sf_dir)), F.col("lang") == F.col("name")).select(F.col("doc_id").alias("document_id"), F.col("id").alias("tag_id"))
    long = docs.where("n_chars > 2000").select(F.col("doc_id").alias("document_id"), F.lit(6).cast("long").alias("tag_id"))
    return by_lang.unionByName(long)


TAGS = """tag(id, name) AS (VALUES (1::BIGINT, 'en'), (2, 'de'), (3, 'fr'), (4, 'es'), (5, 'Unbenutzt'), (6, 'Lang'), (7, 'Älter')),
dtag AS (SELECT doc_id AS document_id, tag.id AS tag_id FROM documents JOIN tag ON lang = name UNION ALL SELECT doc_id, 6 FROM documents WHERE n_chars > 2000)"""

#: Words of the letters' second line, by order priority, and the kind they stand for.
LETTER_KINDS = [("1-URGENT", "Zahlungserinnerung", "Mahnung"), ("2-HIGH", "Angebot", "Angebot"), ("3-MEDIUM", "Lieferschein", "Lieferschein"), ("4-NOT SPECIFIED", "Quittung", "Quittung"), ("5-LOW", "Rechnung", "Rechnung")]


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A German business letter per order: what was put in is known, so what is found can be compared.

    The account number's check sum is wrong for orders with status F; orders with status P have no total line.
    """
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    kinds = F.create_map(*[F.lit(x) for p, w, _ in LETTER_KINDS for x in (p, w)])
    euro = lambda v: F.translate(F.format_number(v, 2), ",.", ".,")
    check = 98 - (F.col("o_orderkey") * 1_000_000 + 131400) % 97
    check = F.when(F.col("o_orderstatus") == "F", F.when(check == 98, 97).otherwise(check + 1)).otherwise(check)
    account = F.concat(F.lit("DE"), F.lpad(check.cast("string"), 2, "0"), F.lpad(F.col("o_orderkey").cast("string"), 18, "0"))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Stadtwerke "), "n_name", F.lit(" GmbH · Weg 1 · 12345 Ort")),
        F.concat(F.coalesce(F.try_element_at(kinds, F.col("o_orderpriority")), F.lit("Brief")), F.lit(" Nr. "), F.col("o_orderkey").cast("string")),
        F.lit("Bezug: Schreiben 01.01.1990"),
        F.concat(F.lit("Datum: "), F.date_format("o_orderdate", "dd.MM.yyyy")),
        F.lit("Listenpreis 9.999.999,00 EUR"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("Gesamtbetrag: 1,00 und "), euro(F.col("o_totalprice")), F.lit(" EUR"))),
        F.concat(F.lit("IBAN "), F.trim(F.regexp_replace(account, "(.{4})", "$1 "))),
    )
    return rows.select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice", "n_name", text.alias("text"))


LETTERS = """letter AS (
  SELECT o_orderkey AS doc_id, o_orderstatus, o_orderpriority, o_orderdate, o_totalprice, n_name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
