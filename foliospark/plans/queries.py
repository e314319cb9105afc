"""Named queries: every operator on the tables at hand, each with the SQL that gives the same rows.

The SQL is written from the operators' definitions, not from their expressions: letters are compared with the
values they were made of, recursions and folds with joins and list functions.
"""

from __future__ import annotations

import base64
import io
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.functions.reference_data import STOPWORDS
from foliospark.operators import catalog, classify, export, folders, metadata, search, terms
from foliospark.plans import bindings as B
from foliospark.plans.store import shared_folder, stored
from foliospark.sources import files as sources
from foliospark.streaming import importer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF_YEAR = 2026
SEARCH = "thre tion"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NORM = "strip_accents(replace(replace(replace(replace(lower({0}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'))"
WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+')"
STOP = "(" + ", ".join(quoted(w) for w in STOPWORDS) + ")"
CONTENT = f"length(term) >= 3 AND term NOT IN {STOP} AND NOT regexp_matches(term, '\\p{{Nd}}')"
TF = f"""tok AS (SELECT doc_id, unnest({WORDS.format(NORM.format('text'))}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE {CONTENT} GROUP BY doc_id, term),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM tf GROUP BY term)"""
FILED = "filed AS (SELECT id AS doc_id, folder_id FROM cat WHERE status = 'abgelegt')"


def rows_of(spark: SparkSession, names: str, *rows: tuple) -> DataFrame:
    """A small table of constants."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v) for v in r]) for r in rows])).alias(*names.split()))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "documents")


def filed(spark: SparkSession, sf: str) -> DataFrame:
    return B.catalog(spark, sf).where("status = 'abgelegt'").select(F.col("id").alias("doc_id"), "folder_id", "correspondent")


# --------------------------------------------------------------------------- text


#: Letters beyond plain Latin, and what they are by the definition.
ODD_TEXTS = ((-1, "ﬁnanz ＡＢ №1", "finanz ab no1"), (-2, "Straße ½ … ²", "strasse 1⁄2 ... 2"), (-3, "U\u0308bung cafe\u0301 𝐀Ⅷ", "uebung cafe aviii"), (-4, "ﬂÄÖ\u00a0ĳ", "flaeoe ij"))


@query(f"SELECT doc_id, {NORM.format('text')} AS norm_text FROM documents UNION ALL SELECT * FROM (VALUES {', '.join(f'({i}, {quoted(n)})' for i, _, n in ODD_TEXTS)})")
def normalise_text(spark, sf):
    odd = rows_of(spark, "doc_id text", *[(i, t) for i, t, _ in ODD_TEXTS]).withColumn("doc_id", F.col("doc_id").cast("long"))
    return documents(spark, sf).select("doc_id", "text").unionByName(odd).select("doc_id", T.norm(F.col("text")).alias("norm_text"))


@query(f"SELECT doc_id, array_to_string({WORDS.format(NORM.format('text'))}, ' ') AS tokens FROM documents")
def tokenise(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, CAST(count(*) FILTER (WHERE {CONTENT}) AS BIGINT) AS n_content, count(DISTINCT term) AS n_terms FROM (SELECT doc_id, unnest({WORDS.format(NORM.format('text'))}) AS term FROM documents UNION ALL SELECT doc_id, NULL FROM documents) GROUP BY doc_id")
def content_words(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.coalesce(T.tokens(F.col("text")), F.array().cast("array<string>")).alias("t"))
    return rows.select("doc_id", F.size(F.filter("t", lambda t: T.is_content_word(t))).cast("long").alias("n_content"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


HTML = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head>', ' ', 'g'), '(?is)<script\b.*?</script>', ' ', 'g'),
 '(?is)<style\b.*?</style>', ' ', 'g'), '(?i)<br\s*/?>|</(p|div|li|tr|h\d)>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g')"""
UNESCAPED = HTML
for _entity, _char in (("&nbsp;", chr(0xA0)), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    UNESCAPED = f"replace({UNESCAPED}, {quoted(_entity)}, {quoted(_char)})"
#: Entities of all kinds, and the text that they are.
ODD_PAGES = ((-1, "<p>a &ndash; b</p>&#8364;&eacute;", " a – b\n€é"), (-2, "&amp;lt; &amp;ndash; &auml;", "&lt; &ndash; ä"), (-3, "&hearts;&#x41;&copy &unknown; &", "♥A© &unknown; &"))


@query(f"SELECT page_id, {UNESCAPED} AS text FROM pages UNION ALL SELECT * FROM (VALUES {', '.join(f'({i}, {quoted(t)})' for i, _, t in ODD_PAGES)})")
def html_to_text(spark, sf):
    odd = rows_of(spark, "page_id html", *[(i, h) for i, h, _ in ODD_PAGES]).withColumn("page_id", F.col("page_id").cast("long"))
    return B.table(spark, sf, "pages").select("page_id", "html").unionByName(odd).select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query(
    "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(x, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(0), ''), "
    r"'[ \t\f\v]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10)) AS text "
    f"FROM (SELECT page_id, chr(13) || chr(10) || {UNESCAPED} || chr(9) AS x FROM pages)"
)
def clean_text(spark, sf):
    raw = F.concat(F.lit("\r\n"), T.html_to_text(F.col("html")), F.lit("\t"))
    return B.table(spark, sf, "pages").select("page_id", T.clean_text(raw).alias("text"))


@query(
    r"""SELECT page_id, coalesce(nullif(rtrim(left(trim(regexp_replace(regexp_replace(url, '[\\/:*?"<>|\x00-\x1f]', ' ', 'g'), '\s+', ' ', 'g'), ' .'), 30), ' .'), ''), 'Dokument') AS name FROM pages"""
)
def safe_filename(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", T.safe_filename(F.col("url"), 30).alias("name"))


@query(
    "SELECT p_partkey, coalesce(array_to_string(list_transform(list_filter(list_zip(ks, range(1, len(ks) + 1)), lambda z: list_position(ks, z[1]) = z[2]), lambda z: z[1]), ', '), '') AS keywords FROM "
    "(SELECT p_partkey, list_filter(list_transform(string_split(replace(replace(p_type || ';' || p_brand || chr(10) || ' , ' || lower(p_type) || ',' || p_name, ';', ','), chr(10), ','), ','), lambda k: lower(trim(k))), lambda k: k <> '') AS ks FROM part)"
)
def clean_keywords(spark, sf):
    raw = F.concat("p_type", F.lit(";"), "p_brand", F.lit("\n , "), F.lower("p_type"), F.lit(","), "p_name")
    return B.table(spark, sf, "part").select("p_partkey", T.clean_keywords(raw).alias("keywords"))


@query(
    f"WITH RECURSIVE {B.folders_sql()}, names AS (SELECT id, name || CASE WHEN id % 7 = 0 THEN '  /x' WHEN id % 11 = 0 THEN repeat(' lang', 30) ELSE ' ' END AS raw FROM fold), "
    r"c AS (SELECT id, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS n FROM names) "
    "SELECT id, CASE WHEN n LIKE '%/%' THEN NULL ELSE left(n, 80) END AS clean, CASE WHEN n LIKE '%/%' THEN 'Ungültiger Ordnername' END AS error FROM c"
)
def folder_name_check(spark, sf):
    i = F.col("id")
    raw = F.concat("name", F.when(i % 7 == 0, "  /x").when(i % 11 == 0, " lang" * 30).otherwise(" "))
    clean, error = T.folder_name(raw)
    return B.folders(spark, sf).select("id", clean.alias("clean"), error.alias("error"))


#: Folder names and the keywords that are suggested for them, written out.
FOLDER_CASES = (
    ("Garten", "garten, kleingarten, parzelle, pacht, gartenverein, kleingartenverein"),
    ("Verträge", "vertrag, arbeitsvertrag, änderungsvertrag, aufhebungsvertrag, vereinbarung, zusatzvereinbarung"),
    ("HAUSRAT", "hausrat, hausratversicherung"),
    (" Bank ", "kontoauszug, girokonto, kontostand, überweisung, kreditkarte, depot"),
    ("Berufsunfähigkeit", "berufsunfähigkeit, berufsunfähigkeitsversicherung, bu-versicherung"),
    ("Pflanzenpass", "pflanzenpass, plant passport"),
    ("Vater", ""),
    ("Sonstiges", ""),
    ("AB", ""),
    ("AU", "arbeitsunfähigkeit, arbeitsunfähigkeitsbescheinigung, au-bescheinigung, krankschreibung, krankmeldung"),
    ("Musterstraße 12", "musterstraße 12"),
)


@query(f"SELECT n_name AS name, lower(n_name) AS keywords FROM nation UNION ALL SELECT * FROM (VALUES {', '.join(f'({quoted(n)}, {quoted(k)})' for n, k in FOLDER_CASES)})")
def suggest_folder_keywords(spark, sf):
    names = B.table(spark, sf, "nation").select(F.col("n_name").alias("name")).unionByName(rows_of(spark, "name", *[(n,) for n, _ in FOLDER_CASES]))
    return names.select("name", T.suggest_folder_keywords(F.col("name")).alias("keywords"))


# --------------------------------------------------------------------------- catalogue


@query(f"WITH {B.CATALOG} SELECT id, title, folder_id, size FROM cat WHERE status = 'eingang'")
def list_by_status(spark, sf):
    return catalog.find(B.catalog(spark, sf), status="eingang").select("id", "title", "folder_id", "size")


@query(f"WITH {B.CATALOG} SELECT id, folder_id, size FROM cat WHERE folder_id IN (SELECT 100 + n_nationkey FROM nation WHERE n_regionkey = 1)")
def list_by_subtree(spark, sf):
    ids = folders.subtree(B.folders(spark, sf), 2)
    return catalog.find(B.catalog(spark, sf), subtree_ids=ids).select("id", "folder_id", "size")


@query("SELECT doc_id AS id, n_chars AS size FROM documents WHERE n_chars > 2000")
def list_by_tag(spark, sf):
    rows = catalog.find(B.catalog(spark, sf), tag="LANG", document_tags=B.document_tags(spark, sf), tags=B.tags(spark, sf))
    return rows.select("id", "size")


@query(f"WITH {B.CATALOG} SELECT id, title, CAST(coalesce(doc_date, created_at) AS VARCHAR) AS day FROM cat ORDER BY coalesce(doc_date, created_at) DESC, id DESC LIMIT 200")
def list_recent(spark, sf):
    rows = search.recent_first(catalog.light(B.catalog(spark, sf)))
    return rows.select("id", "title", F.coalesce("doc_date", "created_at").cast("string").alias("day"))


@query(
    f"WITH {B.CATALOG} SELECT count(*) FILTER (WHERE status = 'eingang') AS inbox, count(*) FILTER (WHERE status = 'abgelegt') AS filed, CAST(sum(size) AS BIGINT) AS bytes_original, "
    "CAST(sum(coalesce(stored_size, size)) AS BIGINT) AS bytes_stored, count(*) FILTER (WHERE stored_size IS NULL) AS optimize_pending, "
    "round((1 - sum(coalesce(stored_size, size)) / sum(size)) * 100) AS saved_percent FROM cat"
)
def catalog_stats(spark, sf):
    return catalog.stats(B.catalog(spark, sf))


@query(f"WITH {B.CATALOG} SELECT folder_id, count(*) AS filed FROM cat WHERE status = 'abgelegt' AND folder_id IS NOT NULL GROUP BY folder_id")
def filed_counts(spark, sf):
    return catalog.filed_counts(B.catalog(spark, sf))


@query(f"WITH {B.CATALOG} SELECT id, size FROM cat WHERE stored_size IS NULL")
def optimize_pending(spark, sf):
    return catalog.optimize_pending(B.catalog(spark, sf))


@query(f"WITH {B.CATALOG} SELECT DISTINCT correspondent FROM cat WHERE status = 'abgelegt'")
def distinct_senders(spark, sf):
    return catalog.distinct_senders(B.catalog(spark, sf))


@query(f"WITH {B.TAGS} SELECT document_id, string_agg(name, '|' ORDER BY lower(name)) AS tags FROM dtag JOIN tag ON tag.id = tag_id GROUP BY document_id")
def document_tags(spark, sf):
    rows = catalog.tags_of(B.document_tags(spark, sf), B.tags(spark, sf))
    return rows.select("document_id", F.array_join("tags", "|").alias("tags"))


@query(f"WITH {B.TAGS} SELECT tag.id, name, count(*) AS count FROM tag JOIN dtag ON tag.id = tag_id GROUP BY tag.id, name")
def tag_counts(spark, sf):
    return catalog.tag_counts(B.document_tags(spark, sf), B.tags(spark, sf))


@query(f"WITH {B.TAGS}, c AS (SELECT tag.id, name, count(*) AS count FROM tag JOIN dtag ON tag.id = tag_id GROUP BY tag.id, name) SELECT *, row_number() OVER (ORDER BY count DESC, lower(name)) AS place FROM c ORDER BY count DESC, lower(name) LIMIT 3")
def top_tags(spark, sf):
    top = catalog.tag_counts(B.document_tags(spark, sf), B.tags(spark, sf), top=3)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("count"), catalog.nocase(F.col("name")))).cast("long"))  # three rows


@query("WITH t AS (SELECT c_custkey AS document_id, 1 + c_custkey % 9 AS n FROM customer) SELECT document_id, array_to_string(list_transform(range(1, least(n, 6) + 1), lambda i: 't' || i), '|') AS tags, CAST(greatest(n - 6, 0) AS INTEGER) AS more FROM t")
def card_tags(spark, sf):
    n = (1 + F.col("c_custkey") % 9).cast("int")
    tagged = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("document_id"), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("t"), i.cast("string"))).alias("tags"))
    out = catalog.card_tags(tagged)
    return out.select("document_id", F.array_join("tags", "|").alias("tags"), "more")


@query(
    f"WITH {B.TAGS}, want AS (SELECT p_partkey AS document_id, p_brand AS name FROM part UNION ALL SELECT p_partkey, 'de' FROM part WHERE p_partkey % 2 = 0) "
    "SELECT name, count(document_id) AS documents FROM (SELECT name, document_id FROM dtag JOIN tag ON id = tag_id UNION SELECT name, document_id FROM want UNION SELECT name, NULL FROM tag) GROUP BY name"
)
def tag_insert(spark, sf):
    part, tags, bridge = B.table(spark, sf, "part"), B.tags(spark, sf), B.document_tags(spark, sf)
    want = part.select(F.col("p_partkey").alias("document_id"), F.col("p_brand").alias("name"))
    want = want.unionByName(part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("document_id"), F.lit("de").alias("name")))
    every, pairs = catalog.tag_rows(want, tags, bridge)
    every = stored(every, "tags")  # ids are given once
    _, pairs = catalog.tag_rows(want, every, bridge)
    named = pairs.distinct().join(every, F.col("tag_id") == F.col("id")).select("name", "document_id").unionByName(every.select("name", F.lit(None).cast("long").alias("document_id")))
    return named.groupBy("name").agg(F.count("document_id").alias("documents"))


@query(f"WITH {B.TAGS} SELECT id, name FROM tag WHERE id NOT IN (SELECT tag_id FROM dtag)")
def orphan_tags(spark, sf):
    return catalog.orphan_tags(B.document_tags(spark, sf), B.tags(spark, sf))


@query(
    r"""WITH raw AS (SELECT p_partkey AS document_id, 0 AS pos, ' ' || p_type || ' ;' AS name FROM part UNION ALL SELECT p_partkey, 1, lower(p_type) FROM part
  UNION ALL SELECT p_partkey, 2, '#' || p_brand FROM part UNION ALL SELECT p_partkey, 3, ' ,; ' FROM part),
c AS (SELECT document_id, pos, left(trim(regexp_replace(name, '\s+', ' ', 'g'), ' ,;#'), 60) AS name FROM raw),
k AS (SELECT *, row_number() OVER (PARTITION BY document_id, lower(name) ORDER BY pos) AS k FROM c WHERE name <> '')
SELECT document_id, CAST(pos AS BIGINT) AS pos, CASE WHEN lower(name) = 'brand#13' THEN 'BRAND#13' ELSE name END AS name FROM k WHERE k = 1"""
)
def normalise_tags(spark, sf):
    part = B.table(spark, sf, "part")
    names = F.array(F.concat(F.lit(" "), "p_type", F.lit(" ;")), F.lower("p_type"), F.concat(F.lit("#"), "p_brand"), F.lit(" ,; "))
    raw = part.select(F.col("p_partkey").alias("document_id"), F.posexplode(names).alias("pos", "name"))
    known = spark.range(1).select(F.lit("BRAND#13").alias("name"))
    return catalog.normalise_tags(raw, known).select("document_id", F.col("pos").cast("long").alias("pos"), "name")


@query(
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT t, min(doc_id) AS first FROM t GROUP BY t) "
    "SELECT t.doc_id AS id, sha256(t.t) AS sha256, first AS original_id FROM t JOIN f ON t.t = f.t WHERE t.doc_id <> first"
)
def exact_duplicates(spark, sf):
    return catalog.exact_duplicates(documents(spark, sf).withColumnRenamed("doc_id", "id"))


@query(
    f"WITH RECURSIVE {B.CATALOG}, {B.folders_sql()}, {B.PATHS}, r AS (SELECT cat.id, replace(path, ' / ', '/') AS dir, "
    "CAST(coalesce(doc_date, created_at) AS VARCHAR) || '_' || 'Dokument ' || tags || ' ' || replace(correspondent, 'Müller ', '') AS stem FROM cat JOIN path ON path.id = folder_id WHERE status = 'abgelegt'), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY dir, stem ORDER BY id) AS k FROM r) "
    "SELECT id, dir || '/' || stem || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END || '.pdf' AS path FROM k"
)
def filing_path(spark, sf):
    return catalog.filing_paths(B.catalog(spark, sf), B.folders(spark, sf))


@query(
    f"WITH RECURSIVE {B.folders_sql()}, {B.PATHS}, s AS (SELECT o_orderkey AS doc_id, 1 + o_custkey % 200 AS folder_id, o_totalprice AS score FROM orders) "
    "SELECT doc_id, CAST(1 AS BIGINT) AS pos, s.folder_id, path, score FROM s JOIN path ON path.id = s.folder_id"
)
def suggestion_refresh(spark, sf):
    old = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).cast("long").alias("pos"), (1 + F.col("o_custkey") % 200).alias("folder_id"), F.lit("alt").alias("path"), F.col("o_totalprice").alias("score"))
    return catalog.refreshed_suggestions(old, B.folders(spark, sf))


@query(
    f"WITH {B.CATALOG} SELECT id, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN 'Betrag ist keine Zahl' WHEN id % 5 = 3 THEN 'Datum bitte als JJJJ-MM-TT' END AS error, "
    "CASE WHEN id % 5 = 0 THEN id + 0.5 ELSE amount END AS amount, CASE WHEN id % 5 = 4 THEN DATE '2025-02-28' ELSE doc_date END AS doc_date FROM cat"
)
def patch_documents(spark, sf):
    rows = B.catalog(spark, sf)
    i = F.col("id") % 5
    patch = rows.select(
        "id",
        F.lit(None).cast("string").alias("title"),
        F.when(i == 3, "2025-02-31").when(i == 4, " 2025-02-28 ").alias("doc_date"),
        F.when(i == 0, F.concat(F.col("id").cast("string"), F.lit(",5"))).when(i == 1, "viel").alias("amount"),
        F.lit(None).cast("string").alias("notes"),
    )
    return catalog.patched(rows, patch).select("id", "error", "amount", "doc_date")


@query(f"WITH {B.CATALOG} SELECT id, title, status FROM cat WHERE id = 42")
def document_by_id(spark, sf):
    return catalog.by_id(B.catalog(spark, sf), 42).select("id", "title", "status")


@query("SELECT doc_id AS id, sha256(coalesce(text, '')) AS sha256 FROM documents WHERE coalesce(text, '') = (SELECT coalesce(text, '') FROM documents WHERE doc_id = 7)")
def document_by_hash(spark, sf):
    docs = documents(spark, sf).select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    wanted = docs.where("id = 7").first()
    return catalog.by_hash(docs, wanted["sha256"] if wanted else "")


@query(f"WITH {B.CATALOG} SELECT original_name, 'files/' || id AS file_path FROM cat WHERE id = 9")
def original_file(spark, sf):
    docs = B.catalog(spark, sf).withColumn("file_path", F.concat(F.lit("files/"), F.col("id").cast("string")))
    return catalog.original_file(docs, 9)


@query("WITH s AS (SELECT 'k' || (event_id % 50) AS key, event_type AS value, event_id AS moment FROM events) SELECT key, arg_max(value, moment) AS value FROM s GROUP BY key")
def settings_upsert(spark, sf):
    rows = B.table(spark, sf, "events").select(F.concat(F.lit("k"), (F.col("event_id") % 50).cast("string")).alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("at"))
    return catalog.upserted(rows.where("at % 3 = 0"), rows.where("at % 3 <> 0"), "key", "at").select("key", "value")


@query("SELECT arg_max(event_type, event_id) AS value FROM events WHERE event_id % 50 = 7")
def setting_lookup(spark, sf):
    return catalog.setting(settings_upsert(spark, sf), "k7").select("value")


@query(
    "WITH d AS (SELECT doc_id, 'n' || doc_id AS original_name, sha256(coalesce(text, '')) AS sha256 FROM documents), old AS (SELECT * FROM d WHERE doc_id % 4 = 0), "
    "new AS (SELECT sha256, min(original_name) AS original_name FROM d WHERE doc_id % 4 <> 0 AND sha256 NOT IN (SELECT sha256 FROM old) GROUP BY sha256) "
    "SELECT sha256, original_name, false AS fresh, true AS one_id FROM old UNION ALL SELECT sha256, original_name, true, true FROM new"
)
def insert_documents(spark, sf):
    docs = documents(spark, sf).select(F.col("doc_id").alias("id"), F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("original_name"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    old, new = docs.where("id % 4 = 0"), docs.where("id % 4 <> 0").drop("id")
    top = old.agg(F.max("id").alias("top"))
    rows = stored(catalog.inserted(old, new), "inserted").crossJoin(F.broadcast(top))  # one row
    ids = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(ids, "id").select("sha256", "original_name", (F.col("id") > F.col("top")).alias("fresh"), (F.col("n") == 1).alias("one_id"))


_GONE = "gone AS (SELECT doc_id FROM labels WHERE toxic = 1)"


def _toxic(spark, sf):
    return B.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")).distinct()


@query(f"WITH {TF}, {B.CATALOG}, {FILED}, {_GONE} SELECT folder_id, term, CAST(sum(tf) AS BIGINT) AS count FROM tf JOIN filed USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM gone) GROUP BY folder_id, term")
def deleted_profiles(spark, sf):
    tf, df = _frequencies(spark, sf)
    profile = terms.folder_terms(tf, filed(spark, sf).drop("correspondent"))
    return catalog.unlearned(B.catalog(spark, sf), _toxic(spark, sf), profile, df)[0]


@query(f"WITH {TF}, {_GONE} SELECT term, count(*) AS df FROM tf WHERE doc_id NOT IN (SELECT doc_id FROM gone) GROUP BY term")
def deleted_frequencies(spark, sf):
    tf, df = _frequencies(spark, sf)
    profile = terms.folder_terms(tf, filed(spark, sf).drop("correspondent"))
    return catalog.unlearned(B.catalog(spark, sf), _toxic(spark, sf), profile, df)[1]


@query(f"WITH {B.CATALOG}, {B.TAGS}, {_GONE} SELECT tag.id, name, count(*) AS count FROM tag JOIN dtag ON tag.id = tag_id WHERE document_id NOT IN (SELECT doc_id FROM gone) AND document_id IN (SELECT id FROM cat) GROUP BY tag.id, name")
def deleted_tags(spark, sf):
    docs, bridge, tags = catalog.deleted(B.catalog(spark, sf), B.document_tags(spark, sf), B.tags(spark, sf), _toxic(spark, sf))
    return catalog.tag_counts(bridge.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi"), tags)


@query(f"WITH {B.CATALOG}, {_GONE} SELECT id, CASE WHEN id IN (SELECT doc_id FROM gone) THEN 'abgelegt' ELSE status END AS status, CASE WHEN id IN (SELECT doc_id FROM gone) THEN 99 ELSE folder_id END AS folder_id FROM cat")
def refile_documents(spark, sf):
    moves = _toxic(spark, sf).withColumn("folder_id", F.lit(99).cast("long"))
    none = spark.createDataFrame([], "folder_id long, term string, count long")
    return catalog.refiled(B.catalog(spark, sf), moves, none)[0].select("id", "status", "folder_id")


@query(f"WITH {TF}, {B.CATALOG}, {_GONE}, put AS (SELECT id AS doc_id, CASE WHEN id IN (SELECT doc_id FROM gone) THEN 99 ELSE folder_id END AS folder_id FROM cat WHERE status = 'abgelegt' OR id IN (SELECT doc_id FROM gone)) SELECT folder_id, term, CAST(sum(tf) AS BIGINT) AS count FROM tf JOIN put USING (doc_id) GROUP BY folder_id, term")
def refile_profiles(spark, sf):
    moves = _toxic(spark, sf).withColumn("folder_id", F.lit(99).cast("long"))
    profile = terms.folder_terms(_frequencies(spark, sf)[0], filed(spark, sf).drop("correspondent"))
    return catalog.refiled(B.catalog(spark, sf), moves, profile)[1]


#: Titles of five documents in each folder, by id, and the file names that they get: a number goes on until its name is free.
NUMBERED = (("A (2)", "A (2)"), ("A", "A"), ("A", "A (3)"), ("A (2)", "A (2) (2)"), ("A (2) (2)", "A (2) (2) (2)"), ("B", "B"), ("B", "B (2)"))


def _numbered_docs(spark, sf):
    titles = rows_of(spark, "no title", *[(k, t) for k, (t, _) in enumerate(NUMBERED)])
    docs = B.table(spark, sf, "nation").crossJoin(F.broadcast(titles))  # seven rows
    day = F.lit("2025-01-01").cast("date")
    return docs.select(
        (F.col("n_nationkey") * 10 + F.col("no")).cast("long").alias("id"), (F.col("n_nationkey") + 100).cast("long").alias("folder_id"), "title", F.lit("x.PDF").alias("original_name"),
        F.lit("abgelegt").alias("status"), day.alias("doc_date"), day.alias("created_at"),
    )


_NUMBERED_SQL = f"t(no, name) AS (VALUES {', '.join(f'({k}, {quoted(n)})' for k, (_, n) in enumerate(NUMBERED))})"


@query(f"WITH {_NUMBERED_SQL} SELECT CAST(n_nationkey * 10 + no AS BIGINT) AS id, r_name || '/' || n_name || '/2025-01-01_' || name || '.pdf' AS path FROM nation JOIN region ON n_regionkey = r_regionkey, t")
def filing_path_numbers(spark, sf):
    return catalog.filing_paths(_numbered_docs(spark, sf), B.folders(spark, sf, False))


def _renamed(spark, sf):
    """The folders with one region renamed and one nation moved to the top."""
    tree = B.folders(spark, sf, False)
    return tree.withColumns({"name": F.when(F.col("id") == 2, "Neu").otherwise(F.col("name")), "parent_id": F.when(F.col("id") != 103, F.col("parent_id"))})


_MOVED = (
    f"{_NUMBERED_SQL}, m AS (SELECT CAST(n_nationkey * 10 + no AS BIGINT) AS id, r_name || '/' || n_name || '/2025-01-01_' || name || '.pdf' AS old, "
    "CASE WHEN n_nationkey = 3 THEN '' WHEN n_regionkey = 1 THEN 'Neu/' ELSE r_name || '/' END || n_name || '/2025-01-01_' || name || '.pdf' AS new FROM nation JOIN region ON n_regionkey = r_regionkey, t)"
)


@query(f"WITH {_MOVED} SELECT id, old, new FROM m WHERE old <> new")
def moved_files(spark, sf):
    return catalog.moved_files(_numbered_docs(spark, sf), B.folders(spark, sf, False), _renamed(spark, sf))


@query(
    f"WITH {_MOVED}, dirs AS (SELECT DISTINCT string_split(old, '/') AS o, string_split(new, '/') AS n FROM m), "
    "b AS (SELECT DISTINCT o[1] AS path FROM dirs UNION SELECT o[1] || '/' || o[2] FROM dirs), a AS (SELECT DISTINCT n[1] AS path FROM dirs UNION SELECT n[1] || '/' || n[2] FROM dirs WHERE len(n) > 2) "
    "SELECT path, CAST(len(string_split(path, '/')) AS INTEGER) AS depth FROM b WHERE path NOT IN (SELECT path FROM a)"
)
def emptied_directories(spark, sf):
    docs = _numbered_docs(spark, sf)
    old, new = (catalog.filing_paths(docs, f(spark, sf)).select("path") for f in (lambda s, d: B.folders(s, d, False), _renamed))
    return catalog.emptied_directories(old, new)


@query(
    f"WITH RECURSIVE {B.CATALOG}, {B.folders_sql()}, {B.PATHS}, {B.TAGS}, tg AS (SELECT document_id, count(*) AS n FROM dtag GROUP BY document_id) "
    "SELECT cat.id, title, status, path AS folder_path, coalesce(tg.n, 0) AS n_tags, CASE WHEN cat.id % 2 = 0 AND path IS NOT NULL THEN path END AS suggested, false AS has_text FROM cat LEFT JOIN path ON path.id = folder_id LEFT JOIN tg ON tg.document_id = cat.id"
)
def document_json(spark, sf):
    docs, tree = B.catalog(spark, sf), B.folders(spark, sf)
    old = docs.where("id % 2 = 0").select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("pos"), "folder_id", F.lit("alt").alias("path"), F.lit(0.5).alias("score"))
    out = catalog.as_json(docs, tree, catalog.tags_of(B.document_tags(spark, sf), B.tags(spark, sf)), old)
    field = lambda p: F.get_json_object("json", p)
    return out.select(
        "id", field("$.title").alias("title"), field("$.status").alias("status"), field("$.folder_path").alias("folder_path"), F.coalesce(F.json_array_length(field("$.tags")), F.lit(0)).cast("long").alias("n_tags"),
        field("$.suggestion[0].path").alias("suggested"), field("$.text").isNotNull().alias("has_text"),
    )


@query("WITH s AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS pos, round(1.0 / (l_linenumber + l_orderkey % 4), 3) AS score FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM s) SELECT doc_id, pos, score FROM k WHERE k = 1 OR score >= 0.15")
def offered_suggestions(spark, sf):
    rows = B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("pos"), F.round(1.0 / (F.col("l_linenumber") + F.col("l_orderkey") % 4), 3).alias("score"))
    return catalog.offered(rows).select("doc_id", "pos", "score")


# --------------------------------------------------------------------------- folders


@query(f"WITH RECURSIVE {B.folders_sql()}, {B.PATHS} SELECT id, path, CAST(depth AS BIGINT) AS depth FROM path")
def folder_paths(spark, sf):
    return folders.folder_paths(B.folders(spark, sf)).withColumn("depth", F.col("depth").cast("long"))


@query("SELECT 2::BIGINT AS id UNION ALL SELECT 100 + n_nationkey FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 1000 + s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def folder_subtree(spark, sf):
    return folders.subtree(B.folders(spark, sf), 2)


@query(f"WITH {B.CATALOG}, {B.folders_sql()}, {FILED} SELECT id, name, (SELECT count(*) FROM filed WHERE filed.folder_id = fold.id) AS count FROM fold")
def folder_direct_counts(spark, sf):
    return folders.direct_counts(B.folders(spark, sf), filed(spark, sf)).select("id", "name", "count")


@query(
    f"WITH {B.CATALOG}, {B.folders_sql()}, {FILED}, own AS (SELECT folder_id AS id, count(*) AS n FROM filed GROUP BY 1) "
    "SELECT fold.id, CAST(coalesce(own.n, 0) + coalesce((SELECT sum(n) FROM own o JOIN fold c ON c.id = o.id WHERE c.parent_id = fold.id), 0) AS BIGINT) AS total FROM fold LEFT JOIN own ON own.id = fold.id"
)
def folder_totals(spark, sf):
    return folders.total_counts(B.folders(spark, sf), filed(spark, sf))


@query(
    "SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, CAST(100 + n_nationkey AS BIGINT) AS new_parent, n_regionkey <> r_regionkey AS ok FROM region, nation "
    "UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(1 + r_regionkey AS BIGINT), true FROM region, nation"
)
def reparent_check(spark, sf):
    tree = B.folders(spark, sf)
    regions, nations = tree.where("id < 99").select("id"), tree.where("id BETWEEN 100 AND 199").select(F.col("id").alias("new_parent"))
    down = regions.join(F.broadcast(nations))  # both are small dimension tables
    up = down.select(F.col("new_parent").alias("id"), F.col("id").alias("new_parent"))
    return folders.reparent_check(tree, down.unionByName(up))


@query(
    f"WITH {B.CATALOG}, {B.folders_sql()}, {FILED} SELECT id, id IN (SELECT parent_id FROM fold WHERE parent_id IS NOT NULL) AS has_children, id IN (SELECT folder_id FROM filed) AS has_documents, "
    "id NOT IN (SELECT parent_id FROM fold WHERE parent_id IS NOT NULL) AND id NOT IN (SELECT folder_id FROM filed) AS ok FROM fold"
)
def folder_delete_check(spark, sf):
    return folders.delete_check(B.folders(spark, sf), filed(spark, sf))


def _outline(spark, sf):
    """The region and nation names as an indented list, regions twice in different spelling."""
    nation, region = B.table(spark, sf, "nation"), B.table(spark, sf, "region")
    lines = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    body = F.concat(F.lit("* "), "r_name", F.lit(":\n"), F.array_join(F.transform("names", lambda n: F.concat(F.lit("\t"), F.lit("1. "), n)), "\n"), F.lit("\n\n* "), F.lower("r_name"), F.lit("\n   - Neu / alt \n   • Neuer  Ordner\n"))
    return lines.select(F.col("r_name").alias("outline_id"), body.alias("text"))


@query(
    "WITH p AS (SELECT r_name AS outline_id, r_name AS path, 1 AS depth, false AS bad FROM region UNION ALL SELECT r_name, r_name || '|' || n_name, 2, false FROM nation JOIN region ON n_regionkey = r_regionkey "
    "UNION ALL SELECT r_name, lower(r_name) || '|Neu / alt', 2, true FROM region UNION ALL SELECT r_name, lower(r_name) || '|Neuer Ordner', 2, false FROM region) "
    "SELECT outline_id, path, CAST(depth AS BIGINT) AS depth, CASE WHEN bad THEN 'Schrägstrich im Ordnernamen' END AS error FROM p"
)
def outline_parse(spark, sf):
    out = folders.parse_outline(_outline(spark, sf))
    return out.select("outline_id", F.array_join("path", "|").alias("path"), "depth", "error")


@query(
    f"WITH RECURSIVE {B.CATALOG}, {B.folders_sql()}, {B.PATHS}, {B.CLOSURE}, {FILED}, tot AS (SELECT anc AS id, count(filed.doc_id) AS n FROM up LEFT JOIN filed ON filed.folder_id = up.desc_id GROUP BY anc), "
    "w AS (SELECT r_name AS path FROM region UNION ALL SELECT r_name || ' / ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT lower(r_name) || ' / Neuer Ordner' FROM region) "
    "SELECT w.path, CASE WHEN path.id IS NULL THEN 'create' ELSE 'exists' END AS action, CAST(coalesce(tot.n, 0) AS BIGINT) AS documents, CASE WHEN path.id IS NULL THEN 'neuer ordner' END AS keywords "
    "FROM w LEFT JOIN path ON lower(w.path) = lower(path.path) LEFT JOIN tot ON tot.id = path.id "
    "UNION ALL SELECT path.path, CASE WHEN tot.n > 0 THEN 'keep_nonempty' ELSE 'remove' END, tot.n, NULL FROM path JOIN tot ON tot.id = path.id WHERE lower(path.path) NOT IN (SELECT lower(path) FROM w)"
)
def outline_diff(spark, sf):
    wanted = folders.parse_outline(_outline(spark, sf)).where("error IS NULL").select("path")
    return folders.outline_diff(wanted, B.folders(spark, sf), filed(spark, sf))


_DIFF_SQL = SQL["outline_diff"]


@query(f"SELECT path, CAST(len(string_split(path, ' / ')) AS INTEGER) AS depth FROM ({_DIFF_SQL}) WHERE action = 'remove'")
def outline_removals(spark, sf):
    return folders.removal_order(outline_diff(spark, sf))


@query("SELECT r_name AS outline_id, 'Schrägstrich im Ordnernamen' AS error FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT r_name, 'Die Liste enthält keine Ordner' FROM region WHERE r_regionkey % 2 = 1 AND r_regionkey > 1")
def outline_errors(spark, sf):
    k = F.col("r_regionkey")
    text = F.when(k % 2 == 0, "* A/B\n* C").when(k > 1, " \n\n").otherwise("* A\n  * B")
    return folders.outline_errors(B.table(spark, sf, "region").select(F.col("r_name").alias("outline_id"), text.alias("text")))


@query("SELECT n_regionkey + 1 AS parent_id, upper(n_name) AS name FROM nation WHERE n_nationkey % 2 = 0")
def folder_name_conflicts(spark, sf):
    n = F.col("n_nationkey")
    wanted = B.table(spark, sf, "nation").select((F.col("n_regionkey") + 1).cast("long").alias("parent_id"), F.when(n % 2 == 0, F.upper("n_name")).otherwise(F.concat("n_name", F.lit("x"))).alias("name"))
    return folders.name_conflicts(B.folders(spark, sf, False), wanted)


@query(f"WITH {B.CATALOG} SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, r_name AS name FROM region WHERE false UNION ALL SELECT * FROM (VALUES (1, 'Finanzen'), (2, 'Bank & Konten'), (3, 'Steuern'), (4, 'Kredite'), (5, 'Rechnungen & Einkäufe'), (6, 'Versicherungen'), (7, 'Wohnen'), (8, 'Miete & Nebenkosten'), (9, 'Energie'), (10, 'Internet & Telefon'), (11, 'Gesundheit'), (12, 'Arbeit'), (13, 'Gehaltsabrechnungen'), (14, 'Verträge & Zeugnisse'), (15, 'Fahrzeuge'), (16, 'Behörden & Ausweise'), (17, 'Verträge & Abos'), (18, 'Bildung'), (19, 'Sonstiges'))")
def seed_folders(spark, sf):
    return folders.seed_folders(spark).select("id", "name")


# --------------------------------------------------------------------------- terms


@query(f"WITH {TF}, {_GONE} SELECT term, count(*) AS df FROM tf WHERE doc_id % 3 <> 0 OR doc_id IN (SELECT doc_id FROM gone) GROUP BY term")
def term_df_delta(spark, sf):
    tf = stored(terms.term_frequency(documents(spark, sf)), "tf")
    toxic = _toxic(spark, sf).withColumnRenamed("id", "doc_id")
    have = tf.where("doc_id % 3 <> 0")
    later = tf.where("doc_id % 3 = 0")
    old = terms.document_frequency(have.unionByName(later))
    lost = terms.document_frequency(later.join(toxic, "doc_id", "left_anti")).withColumn("df", -F.col("df"))
    return terms.apply_delta(old, lost, ("term",), "df")


@query(f"WITH {TF} SELECT doc_id, term, tf FROM tf")
def term_frequency(spark, sf):
    return terms.term_frequency(documents(spark, sf))


@query(f"WITH {TF} SELECT term, df FROM df")
def term_df(spark, sf):
    return terms.document_frequency(terms.term_frequency(documents(spark, sf)))


@query(f"WITH {TF}, {B.CATALOG}, {FILED} SELECT folder_id, term, CAST(sum(tf) AS BIGINT) AS count FROM tf JOIN filed USING (doc_id) GROUP BY folder_id, term")
def folder_terms(spark, sf):
    return terms.folder_terms(terms.term_frequency(documents(spark, sf)), filed(spark, sf).drop("correspondent"))


@query(
    f"WITH {TF}, {B.CATALOG}, {FILED}, moved AS (SELECT doc_id, CASE WHEN tags = 'de' THEN 99 ELSE filed.folder_id END AS folder_id FROM filed JOIN cat ON cat.id = doc_id) "
    "SELECT folder_id, term, CAST(sum(tf) AS BIGINT) AS count FROM tf JOIN moved USING (doc_id) GROUP BY folder_id, term"
)
def folder_terms_delta(spark, sf):
    tf, at = terms.term_frequency(documents(spark, sf)), filed(spark, sf).drop("correspondent")
    german = at.join(documents(spark, sf).where("lang = 'de'").select("doc_id"), "doc_id", "left_semi")
    old = terms.folder_terms(tf, german)
    new = terms.folder_terms(tf, german.withColumn("folder_id", F.lit(99).cast("long")))
    delta = old.withColumn("count", -F.col("count")).unionByName(new)
    return terms.apply_delta(terms.folder_terms(tf, at), delta)


COSINE = f"""n AS (SELECT count(*) AS n FROM documents),
prof AS (SELECT folder_id, term, sum(tf) AS c FROM tf JOIN filed USING (doc_id) GROUP BY folder_id, term),
dv AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((n + 1) / (coalesce(df, 0) + 1)) + 1) AS w FROM tf LEFT JOIN df USING (term), n),
fv AS (SELECT folder_id, term, (1 + ln(c)) * (ln((n + 1) / (coalesce(df, 0) + 1)) + 1) AS w FROM prof LEFT JOIN df USING (term), n),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS nw FROM dv GROUP BY doc_id), fn AS (SELECT folder_id, sqrt(sum(w * w)) AS nw FROM fv GROUP BY folder_id),
cosine AS (SELECT dv.doc_id, fv.folder_id, sum(dv.w * fv.w) / (any_value(dn.nw) * any_value(fn.nw)) AS cos
  FROM dv JOIN fv USING (term) JOIN dn ON dn.doc_id = dv.doc_id JOIN fn ON fn.folder_id = fv.folder_id GROUP BY dv.doc_id, fv.folder_id)"""


@query(f"WITH {TF}, {B.CATALOG}, {FILED}, {COSINE} SELECT doc_id, folder_id, round(cos, 6) AS cos FROM cosine")
def tfidf_cosine(spark, sf):
    tf, df = _frequencies(spark, sf)
    out = classify.learned_scores(documents(spark, sf), filed(spark, sf).drop("correspondent"), tf=tf, df=df)
    return out.select("doc_id", "folder_id", F.round("cos", 6).alias("cos"))


SURFACE = f"""sa AS (SELECT doc_id, {WORDS.format('text')} AS fs FROM documents),
sw AS (SELECT doc_id, unnest(fs) AS form, unnest(range(len(fs))) AS place FROM sa),
st AS (SELECT doc_id, form, place, {NORM.format('form')} AS term, regexp_matches(form, '^\\p{{Lu}}') AS up FROM sw),
sc AS (SELECT * FROM st WHERE length(term) >= 4 AND {CONTENT}),
sf AS (SELECT doc_id, term, form, count(*) AS n, min(place) AS place, bool_or(up) AND NOT (form = upper(form) AND form <> lower(form)) AS titled FROM sc GROUP BY doc_id, term, form),
best AS (SELECT doc_id, term, form FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, term ORDER BY titled DESC, n DESC, place) AS k FROM sf) WHERE k = 1),
ks AS (SELECT doc_id, term, count(*) AS tf, count(*) FILTER (WHERE up) AS cap FROM sc GROUP BY doc_id, term),
nc AS (SELECT doc_id, count(*) FILTER (WHERE cap > 0) AS capitals FROM ks GROUP BY doc_id),
kn AS (SELECT count(*) AS n FROM documents),
scored AS (SELECT ks.doc_id, ks.term, ks.tf, ks.cap,
  CASE WHEN form = upper(form) AND form <> lower(form) AND length(form) > 4 THEN upper(left(form, 1)) || lower(substr(form, 2)) ELSE form END AS form,
  (1 + ln(ks.tf)) * (ln((n + 1) / (coalesce(df, 0) + 1)) + 1) * (0.4 + ks.cap / ks.tf) * least(1.0, length(ks.term) / 6) AS score
  FROM ks JOIN nc USING (doc_id) JOIN best ON best.doc_id = ks.doc_id AND best.term = ks.term LEFT JOIN df ON df.term = ks.term, kn WHERE cap > 0 OR capitals < 8)"""


@query(f"WITH {TF}, {SURFACE} SELECT doc_id, term, tf, cap, form, round(score, 6) AS score FROM scored")
def keyword_scores(spark, sf):
    docs = documents(spark, sf)
    df = terms.document_frequency(terms.term_frequency(docs))
    out = metadata.keyword_scores(docs, df, docs.agg(F.count(F.lit(1)).alias("n")))
    return out.select("doc_id", "term", "tf", "cap", "form", F.round("score", 6).alias("score"))


@query(
    f"WITH RECURSIVE {TF}, {SURFACE}, o AS (SELECT *, {NORM.format('form')} AS key, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, term DESC) AS k FROM scored), "
    "pick(doc_id, k, keys, forms) AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM o UNION ALL "
    "SELECT p.doc_id, o.k, CASE WHEN len(list_filter(p.keys, lambda x: contains(x, o.term) OR contains(o.term, x))) > 0 THEN p.keys ELSE list_append(p.keys, o.key) END, "
    "CASE WHEN len(list_filter(p.keys, lambda x: contains(x, o.term) OR contains(o.term, x))) > 0 THEN p.forms ELSE list_append(p.forms, o.form) END "
    "FROM pick p JOIN o ON o.doc_id = p.doc_id AND o.k = p.k + 1 WHERE len(p.keys) < 8) "
    "SELECT doc_id, arg_max(array_to_string(forms, ', '), k) AS keywords FROM pick GROUP BY doc_id"
)
def document_keywords(spark, sf):
    docs = documents(spark, sf)
    df = terms.document_frequency(terms.term_frequency(docs))
    scored = metadata.keyword_scores(docs, df, docs.agg(F.count(F.lit(1)).alias("n"))).withColumn("score", F.round("score", 9))
    return metadata.pick_keywords(scored).select("doc_id", F.array_join("keywords", ", ").alias("keywords"))


# --------------------------------------------------------------------------- search

FOLDED = "strip_accents(lower({0}))"
_FIELDS = " || ' ' || ".join(FOLDED.format(f"coalesce({c}, '')") for c in search.FIELDS)
_PREFIX = ["thre", "tion"]


@query(
    f"WITH {B.CATALOG}, w AS (SELECT id, coalesce(doc_date, created_at) AS day, {WORDS.format(_FIELDS)} AS ws FROM cat), "
    f"h AS (SELECT id, day, len(ws) AS len, len(list_filter(ws, lambda x: starts_with(x, {quoted(_PREFIX[0])}))) AS f0, len(list_filter(ws, lambda x: starts_with(x, {quoted(_PREFIX[1])}))) AS f1 FROM w), "
    "s AS (SELECT count(*) AS n, avg(len) AS a, count(*) FILTER (WHERE f0 > 0) AS n0, count(*) FILTER (WHERE f1 > 0) AS n1 FROM h), "
    "i AS (SELECT n, a, CASE WHEN n0 + n0 >= n THEN 1e-6 ELSE ln((n - n0 + 0.5) / (n0 + 0.5)) END AS i0, CASE WHEN n1 + n1 >= n THEN 1e-6 ELSE ln((n - n1 + 0.5) / (n1 + 0.5)) END AS i1 FROM s), "
    "r AS (SELECT id, day, round(-(i0 * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * len / a)) + i1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score FROM h, i WHERE f0 > 0 AND f1 > 0) "
    "SELECT id, score FROM r ORDER BY score, day DESC, id DESC LIMIT 200"
)
def bm25_search(spark, sf):
    hits = search.bm25(B.catalog(spark, sf), SEARCH)
    return search.recent_first(hits, ranked=True).select("id", F.round("score", 6).alias("score"))


@query(SQL["bm25_search"].replace("ORDER BY score, day DESC, id DESC LIMIT 200", ""))
def bm25_indexed(spark, sf):
    hits = search.bm25_indexed(search.build_index(B.catalog(spark, sf)), SEARCH)
    return hits.select("id", F.round("score", 6).alias("score"))


@query("SELECT doc_id AS id, 0.0::DOUBLE AS score FROM documents")
def bm25_without_words(spark, sf):
    return search.bm25_indexed(search.build_index(B.catalog(spark, sf)), ' " ( ')


@query(SQL["bm25_indexed"].replace("FROM cat)", "FROM (SELECT * REPLACE (CASE WHEN tags = 'de' THEN 'three thre' WHEN tags = 'fr' THEN '' ELSE text END AS text) FROM cat WHERE tags <> 'es')), ", 1).replace(")), , h AS", ")), h AS"))
def index_upsert(spark, sf):
    docs = B.catalog(spark, sf)
    changed = docs.where("tags IN ('de', 'fr')").withColumn("text", F.when(F.col("tags") == "de", "three thre").otherwise(""))
    index = search.upserted_index(search.build_index(docs), changed)
    index = search.dropped_from_index(index, docs.where("tags = 'es'"))
    return search.bm25_indexed(index, SEARCH).select("id", F.round("score", 6).alias("score"))


_HIT = f"len(list_filter({WORDS.format(FOLDED.format('x'))}, lambda y: starts_with(y, 'thre') OR starts_with(y, 'tion'))) > 0"


@query(
    f"WITH hits AS ({SQL['bm25_search']}), w AS (SELECT d.doc_id AS id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS ws FROM documents d JOIN hits ON hits.id = d.doc_id), "
    f"f AS (SELECT id, ws, list_transform(ws, lambda x: CASE WHEN {_HIT} THEN 1 ELSE 0 END) AS fs FROM w), "
    "n AS (SELECT id, ws, fs, list_transform(range(0, greatest(len(ws) - 14, 0) + 1), lambda s: list_sum(fs[s + 1 : s + 14])) AS ns FROM f), "
    "b AS (SELECT id, ws, fs, list_position(ns, list_max(ns)) - 1 AS place FROM n), "
    "m AS (SELECT id, place, len(ws) AS n, list_transform(range(place + 1, least(place + 14, len(ws)) + 1), lambda i: CASE WHEN fs[i] = 1 THEN chr(1) || ws[i] || chr(2) ELSE ws[i] END) AS shown FROM b) "
    "SELECT id, CASE WHEN place > 0 THEN '…' ELSE '' END || array_to_string(shown, ' ') || CASE WHEN place + 14 < n THEN '…' ELSE '' END AS snippet FROM m"
)
def search_snippets(spark, sf):
    hits = search.recent_first(search.bm25(B.catalog(spark, sf), SEARCH), ranked=True)
    return hits.select("id", search.snippet(F.col("text"), SEARCH).alias("snippet"))


# --------------------------------------------------------------------------- metadata of letters


@query(f"WITH {B.LETTERS}, k(p, kind) AS (VALUES {', '.join(f'({quoted(p)}, {quoted(k)})' for p, _, k in B.LETTER_KINDS)}) SELECT doc_id, kind AS doc_type FROM letter LEFT JOIN k ON o_orderpriority = p")
def doc_type(spark, sf):
    return B.letters(spark, sf).select("doc_id", metadata.doc_type(F.col("text")).alias("doc_type"))


@query(f"WITH {B.LETTERS} SELECT doc_id, CAST(o_orderdate AS DATE) AS doc_date FROM letter")
def document_date(spark, sf):
    return B.letters(spark, sf).select("doc_id", metadata.document_date(F.col("text"), AS_OF_YEAR).alias("doc_date"))


@query(f"WITH {B.LETTERS} SELECT doc_id, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice, 2) ELSE 9999999.0 END AS amount FROM letter")
def document_amount(spark, sf):
    return B.letters(spark, sf).select("doc_id", metadata.amount(F.col("text")).alias("amount"))


_BBAN = "lpad(CAST(doc_id AS VARCHAR), 18, '0')"


@query(
    f"WITH {B.LETTERS}, c AS (SELECT doc_id, o_orderstatus, 'DE' || lpad(CAST(98 - (CAST(doc_id AS HUGEINT) * 1000000 + 131400) % 97 AS VARCHAR), 2, '0') || {_BBAN} AS iban FROM letter) "
    "SELECT doc_id, CASE WHEN o_orderstatus <> 'F' THEN array_to_string(list_transform(range(0, 6), lambda i: substr(iban, 4 * i + 1, 4)), ' ') END AS iban FROM c"
)
def document_iban(spark, sf):
    return B.letters(spark, sf).select("doc_id", metadata.iban(F.col("text")).alias("iban"))


@query(
    "WITH c AS (SELECT c_custkey, 'DE' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey AS VARCHAR), 18, '0') AS iban FROM customer), "
    "d AS (SELECT c_custkey, iban, list_transform(string_split(substr(iban, 5) || left(iban, 4), ''), lambda x: CASE WHEN ascii(x) > 57 THEN CAST(ascii(x) - 55 AS VARCHAR) ELSE x END) AS parts FROM c) "
    "SELECT c_custkey, iban, CAST(array_to_string(parts, '') AS HUGEINT) % 97 = 1 AS ok FROM d"
)
def iban_check(spark, sf):
    key = F.col("c_custkey")
    code = F.concat(F.lit("DE"), F.lpad((key % 100).cast("string"), 2, "0"), F.lpad(key.cast("string"), 18, "0"))
    return B.table(spark, sf, "customer").select("c_custkey", code.alias("iban"), metadata.iban_ok(code).alias("ok"))


@query(
    "WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 130 AS y, l_linenumber * 2 AS m, CAST(l_quantity AS INTEGER) AS d FROM lineitem), "
    "f AS (SELECT *, CASE WHEN y < 70 THEN y + 2000 WHEN y < 100 THEN y + 1900 ELSE y END AS yy FROM p) "
    "SELECT l_orderkey, l_linenumber, CASE WHEN yy BETWEEN 1950 AND 2028 THEN TRY_CAST(format('{:04d}-{:02d}-{:02d}', yy, m, d) AS DATE) END AS valid FROM f"
)
def valid_date(spark, sf):
    y, m, d = (F.col("l_partkey") % 130).cast("int"), F.col("l_linenumber") * 2, F.col("l_quantity").cast("int")
    return B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", metadata.valid_date(y, m, d, AS_OF_YEAR).alias("valid"))


@query(f"WITH {B.LETTERS} SELECT doc_id, 'Stadtwerke ' || n_name || ' GmbH' AS sender FROM letter")
def header_sender(spark, sf):
    return B.letters(spark, sf).select("doc_id", metadata.header_sender(F.col("text")).alias("sender"))


@query(f"WITH {B.LETTERS} SELECT doc_id, n_name AS sender FROM letter")
def known_sender(spark, sf):
    names = B.table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    return metadata.known_sender(B.letters(spark, sf), names).select("doc_id", F.col("known_sender").alias("sender"))


@query(f"WITH {B.LETTERS}, k(p, kind) AS (VALUES {', '.join(f'({quoted(p)}, {quoted(k)})' for p, _, k in B.LETTER_KINDS)}) SELECT doc_id, coalesce(kind || ' ', '') || 'Stadtwerke ' || n_name || CASE WHEN kind IS NULL THEN ' Strom' ELSE '' END AS title FROM letter LEFT JOIN k ON o_orderpriority = p")
def suggest_title(spark, sf):
    t = F.col("text")
    keys = F.array(F.lit("Strom"), F.lit("Gas"))
    return B.letters(spark, sf).select("doc_id", metadata.suggest_title(metadata.doc_type(t), metadata.header_sender(t), keys, F.lit("ohne Titel")).alias("title"))


_IBAN_SQL = SQL["document_iban"]


@query(
    f"WITH {B.LETTERS}, k(p, kind) AS (VALUES {', '.join(f'({quoted(p)}, {quoted(k)})' for p, _, k in B.LETTER_KINDS)}) SELECT letter.doc_id, kind AS doc_type, CAST(o_orderdate AS DATE) AS doc_date, "
    "CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice, 2) ELSE 9999999.0 END AS amount, i.iban, 'Stadtwerke ' || n_name AS correspondent, kind || ' Stadtwerke ' || n_name AS suggested_title, true AS has_keywords "
    f"FROM letter LEFT JOIN k ON o_orderpriority = p JOIN ({_IBAN_SQL}) i ON i.doc_id = letter.doc_id"
)
def letter_analysis(spark, sf):
    rows = B.letters(spark, sf).select("doc_id", "text", F.lit("ohne Titel").alias("title"))
    df = terms.document_frequency(terms.term_frequency(rows))
    names = B.table(spark, sf, "nation").select(F.concat(F.lit("Stadtwerke "), "n_name").alias("name"))
    out = metadata.analyse(rows, df, rows.agg(F.count(F.lit(1)).alias("n")), names, AS_OF_YEAR)
    return out.select("doc_id", "doc_type", "doc_date", "amount", "iban", "correspondent", "suggested_title", (F.size("keywords") > 0).alias("has_keywords"))


#: How months are written in letters, by their number.
MONTH_NAMES = ("Januar", "Feb", "März", "Apr", "Mai", "Juni", "JULI", "August", "Sept", "Oktober", "Nov", "Dezember")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS doc_date FROM orders")
def worded_dates(spark, sf):
    orders = B.table(spark, sf, "orders")
    month = F.get(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month("o_orderdate") - 1)
    text = F.concat(F.lit("Berlin, den "), F.date_format("o_orderdate", "d"), F.lit(". "), month, F.lit(" "), F.date_format("o_orderdate", "yyyy"), F.lit("\nBezug: Schreiben 01.01.1990"))
    text = F.when(F.col("o_orderkey") % 5 != 0, text).otherwise("Frist 31.02.2025, 3. Monat 2025, 99.99.99")
    return orders.select(F.col("o_orderkey").alias("doc_id"), metadata.document_date(text, AS_OF_YEAR).alias("doc_date"))


# --------------------------------------------------------------------------- classification

_KEYS = f"""raw AS (SELECT id AS folder_id, unnest(string_split(replace(replace(keywords, ';', ','), chr(10), ','), ',')) AS k FROM fold),
keys AS (SELECT DISTINCT folder_id, trim(k) AS keyword, array_to_string({WORDS.format(NORM.format('k'))}, ' ') AS phrase FROM raw WHERE trim(k) <> ''),
ph AS (SELECT DISTINCT phrase FROM keys WHERE phrase <> ''),
alltok AS (SELECT doc_id, {WORDS.format(NORM.format('text'))} AS ws FROM documents),
hit AS (
  SELECT doc_id, phrase, CASE WHEN contains(phrase, ' ') THEN len(string_split(' ' || array_to_string(ws, ' ') || ' ', ' ' || phrase || ' ')) - 1
         WHEN length(phrase) >= 5 THEN len(list_filter(ws, lambda w: contains(w, phrase))) ELSE len(list_filter(ws, lambda w: w = phrase)) END AS hits FROM alltok, ph),
hits AS (SELECT doc_id, phrase, CAST(hits AS BIGINT) AS hits FROM hit WHERE hits > 0)"""
_OWN = "own AS (SELECT doc_id, folder_id, sum(1 + 0.5 * ln(hits)) AS w FROM hits JOIN keys USING (phrase) GROUP BY doc_id, folder_id)"
_INHERITED = "rules AS (SELECT doc_id, desc_id AS folder_id, sum(w * pow(0.5, depth)) AS w FROM own JOIN up ON up.anc = own.folder_id WHERE depth <= 10 GROUP BY doc_id, desc_id)"
_SENDERS = """sv AS (SELECT correspondent, folder_id, count(*) AS votes FROM cat WHERE status = 'abgelegt' GROUP BY correspondent, folder_id),
stot AS (SELECT correspondent, sum(votes) AS total FROM sv GROUP BY correspondent),
send AS (SELECT cat.id AS doc_id, sv.folder_id, votes, 0.95 * votes / (total + 0.25) AS sender FROM cat JOIN sv ON cat.correspondent = sv.correspondent JOIN stot ON stot.correspondent = sv.correspondent)"""


@query(f"WITH {B.folders_sql(False)}, {_KEYS} SELECT doc_id, phrase, hits FROM hits")
def rule_hits(spark, sf):
    return classify.rule_hits(documents(spark, sf), B.folders(spark, sf, False))


@query(f"WITH RECURSIVE {B.folders_sql(False)}, {_KEYS}, {_OWN}, {B.CLOSURE}, {_INHERITED} SELECT doc_id, folder_id, round(w, 6) AS w FROM rules")
def inherited_rule_weight(spark, sf):
    tree = B.folders(spark, sf, False)
    own = classify.own_weights(classify.rule_hits(documents(spark, sf), tree), tree)
    return classify.inherited_weights(own, tree).withColumn("w", F.round("w", 6))


@query(f"WITH {B.CATALOG}, {_SENDERS} SELECT doc_id, folder_id, votes, round(sender, 6) AS sender FROM send")
def sender_votes(spark, sf):
    docs = B.catalog(spark, sf).select(F.col("id").alias("doc_id"), "correspondent")
    return classify.sender_votes(docs, filed(spark, sf)).withColumn("sender", F.round("sender", 6))


def _frequencies(spark, sf):
    """tf and df of all documents, computed once and read by each step."""
    tf = stored(terms.term_frequency(documents(spark, sf)), "tf")
    return tf, stored(terms.document_frequency(tf), "df")


def _scores(spark, sf):
    tree = B.folders(spark, sf, False)
    docs, at = documents(spark, sf), stored(filed(spark, sf), "filed")
    hits = stored(classify.rule_hits(docs, tree), "hits")
    rules = classify.inherited_weights(classify.own_weights(hits, tree), tree)
    tf, df = _frequencies(spark, sf)
    learned = classify.learned_scores(docs, at.drop("correspondent"), tf=tf, df=df)
    senders = classify.sender_votes(B.catalog(spark, sf).select(F.col("id").alias("doc_id"), "correspondent"), at)
    return stored(classify.folder_scores(rules, learned, senders), "scores"), hits, tree, docs


_SCORES = f"""{TF}, {B.CATALOG}, {FILED}, {COSINE}, {B.folders_sql(False)}, {_KEYS}, {_OWN}, {B.CLOSURE}, {_INHERITED}, {_SENDERS},
fc AS (SELECT folder_id, count(*) AS n FROM filed GROUP BY folder_id),
learned AS (SELECT doc_id, folder_id, least(1.0, 1.5 * cos) * n / (n + 1) AS l FROM cosine JOIN fc USING (folder_id)),
pairs AS (SELECT doc_id, folder_id FROM rules UNION SELECT doc_id, folder_id FROM learned UNION SELECT doc_id, folder_id FROM send),
sc AS (SELECT p.doc_id, p.folder_id, 1 - (1 - coalesce(w / (w + 1.5), 0)) * (1 - coalesce(l, 0)) * (1 - coalesce(sender, 0)) AS score
  FROM pairs p LEFT JOIN rules r ON r.doc_id = p.doc_id AND r.folder_id = p.folder_id LEFT JOIN learned x ON x.doc_id = p.doc_id AND x.folder_id = p.folder_id
  LEFT JOIN send s ON s.doc_id = p.doc_id AND s.folder_id = p.folder_id)"""


@query(f"WITH RECURSIVE {_SCORES} SELECT doc_id, folder_id, round(score, 6) AS score FROM sc WHERE score > 0")
def folder_scores(spark, sf):
    return _scores(spark, sf)[0].select("doc_id", "folder_id", F.round("score", 6).alias("score"))


@query(
    f"WITH RECURSIVE {_SCORES}, {B.PATHS}, r AS (SELECT doc_id, folder_id, path, round(score, 3) AS score FROM sc JOIN path ON path.id = folder_id WHERE score > 0), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, path) AS pos FROM r), b AS (SELECT * FROM k WHERE pos <= 3), "
    "weak AS (SELECT d.doc_id FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id GROUP BY d.doc_id HAVING coalesce(max(b.score), 0) < 0.1 AND count(*) FILTER (WHERE b.folder_id = 99) = 0) "
    "SELECT doc_id, pos, folder_id, path, score FROM b UNION ALL SELECT doc_id, 0, 99, 'Sonstiges', 0.0 FROM weak"
)
def folder_suggestions(spark, sf):
    scores, _, tree, docs = _scores(spark, sf)
    return classify.suggestions(scores, tree, docs)


@query(
    f"WITH RECURSIVE {_SCORES}, "
    "raw2 AS (SELECT id AS folder_id, string_split(replace(replace(keywords, ';', ','), chr(10), ','), ',') AS ks FROM fold), "
    "pos AS (SELECT folder_id, trim(k) AS keyword, min(i) AS pos FROM (SELECT folder_id, unnest(list_filter(list_transform(ks, lambda x: trim(x)), lambda x: x <> '')) AS k, unnest(range(len(list_filter(ks, lambda x: trim(x) <> '')))) AS i FROM raw2) GROUP BY 1, 2), "
    "offer AS (SELECT desc_id AS folder_id, depth, pos, keys.keyword, phrase FROM keys JOIN pos ON pos.folder_id = keys.folder_id AND pos.keyword = keys.keyword JOIN up ON up.anc = keys.folder_id WHERE phrase <> ''), "
    "best AS (SELECT doc_id, offer.folder_id, keyword, max(hits) AS n, min(depth * 1000 + pos) AS place FROM hits JOIN offer USING (phrase) GROUP BY 1, 2, 3), "
    "top AS (SELECT doc_id, folder_id, string_agg(keyword, ', ' ORDER BY n DESC, place) AS words FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, folder_id ORDER BY n DESC, place) AS k FROM best) WHERE k <= 5 GROUP BY 1, 2) "
    "SELECT sc.doc_id, sc.folder_id, array_to_string(list_filter([CASE WHEN words IS NOT NULL THEN 'Begriffe: ' || words END, "
    "CASE WHEN l >= 0.05 THEN 'ähnlich zu ' || fc.n || CASE WHEN fc.n = 1 THEN ' abgelegten Dokument' ELSE ' abgelegten Dokumenten' END END, "
    "CASE WHEN votes IS NOT NULL THEN votes || '× von ' || send.correspondent || ' hier abgelegt' END], lambda x: x IS NOT NULL), '; ') AS reasons "
    "FROM sc LEFT JOIN top ON top.doc_id = sc.doc_id AND top.folder_id = sc.folder_id LEFT JOIN learned ON learned.doc_id = sc.doc_id AND learned.folder_id = sc.folder_id LEFT JOIN fc ON fc.folder_id = sc.folder_id "
    "LEFT JOIN (SELECT s.*, cat.correspondent FROM send s JOIN cat ON cat.id = s.doc_id) send ON send.doc_id = sc.doc_id AND send.folder_id = sc.folder_id WHERE score > 0"
)
def suggestion_reasons(spark, sf):
    scores, hits, tree, _ = _scores(spark, sf)
    senders = B.catalog(spark, sf).select(F.col("id").alias("doc_id"), "correspondent")
    out = classify.reasons(scores, hits, tree, senders)
    return out.select("doc_id", "folder_id", F.array_join("reasons", "; ").alias("reasons"))


_OUT_SCORES = (
    _SCORES.replace("learned AS (SELECT doc_id, folder_id, least(1.0, 1.5 * cos) * n / (n + 1) AS l FROM cosine JOIN fc USING (folder_id))",
                    "own2 AS (SELECT doc_id, folder_id, 1 AS me FROM filed), learned AS (SELECT c.doc_id, c.folder_id, least(1.0, 1.5 * cos) * (n - coalesce(me, 0)) / (n - coalesce(me, 0) + 1) AS l "
                    "FROM cosine c JOIN fc ON fc.folder_id = c.folder_id LEFT JOIN own2 ON own2.doc_id = c.doc_id AND own2.folder_id = c.folder_id WHERE n > coalesce(me, 0))")
    .replace("send AS (SELECT cat.id AS doc_id, sv.folder_id, votes, 0.95 * votes / (total + 0.25) AS sender FROM cat JOIN sv ON cat.correspondent = sv.correspondent JOIN stot ON stot.correspondent = sv.correspondent)",
             "send AS (SELECT cat.id AS doc_id, sv.folder_id, votes - CASE WHEN status = 'abgelegt' AND cat.folder_id = sv.folder_id THEN 1 ELSE 0 END AS votes, "
             "0.95 * (votes - CASE WHEN status = 'abgelegt' AND cat.folder_id = sv.folder_id THEN 1 ELSE 0 END) / (total - CASE WHEN status = 'abgelegt' THEN 1 ELSE 0 END + 0.25) AS sender "
             "FROM cat JOIN sv ON cat.correspondent = sv.correspondent JOIN stot ON stot.correspondent = sv.correspondent WHERE votes > CASE WHEN status = 'abgelegt' AND cat.folder_id = sv.folder_id THEN 1 ELSE 0 END)")
)


@query(SQL["folder_suggestions"].replace(_SCORES, _OUT_SCORES))
def resuggestions(spark, sf):
    tf, df = _frequencies(spark, sf)
    docs = B.catalog(spark, sf).select(F.col("id").alias("doc_id"), "text", "correspondent")
    return classify.resuggest(docs, B.folders(spark, sf, False), stored(filed(spark, sf), "filed"), tf=tf, df=df)


# --------------------------------------------------------------------------- export


@query("WITH p AS (SELECT CAST(100 + n_nationkey AS BIGINT) AS folder_id, r_name || ' / ' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey + 1, r_name FROM region UNION ALL SELECT 99, 'Sonstiges') SELECT folder_id, path, replace(path, ' / ', '/') || '/{{ created_year }}-{{ created_month }}-{{ created_day }}_{{ title }}' AS template FROM p")
def storage_paths(spark, sf):
    return export.storage_paths(B.folders(spark, sf, False))


#: Task reports of an archive's versions, the document that they name, and what they say if they failed.
TASKS = (
    ('{"related_document": "12", "result": "ok"}', 12, "ok"),
    ('{"related_document": null, "related_document_ids": [7, 8]}', 7, "Verarbeitung im Archiv fehlgeschlagen"),
    ('{"result_data": {"document_id": 5}}', 5, '{"document_id":5}'),
    ('{"related_document": "", "result": "", "result_message": "Duplicate"}', None, "Duplicate"),
    ("{}", None, "Verarbeitung im Archiv fehlgeschlagen"),
)


@query(f"SELECT * FROM (VALUES {', '.join(f'({k}, {d or chr(78) + chr(85) + chr(76) * 2}::BIGINT, {quoted(e)})' for k, (_, d, e) in enumerate(TASKS))}) t(no, document, error)")
def task_reports(spark, sf):
    rows = rows_of(spark, "no task", *[(k, t) for k, (t, _, _) in enumerate(TASKS)])
    return rows.select("no", export.task_document(F.col("task")).alias("document"), export.task_error(F.col("task")).alias("error"))


@query("SELECT count(*) FILTER (WHERE event_id % 5 > 2) AS done, count(*) FILTER (WHERE event_id % 5 IN (0, 1)) AS skipped, count(*) FILTER (WHERE event_id % 5 = 2) AS errors FROM events")
def export_outcomes(spark, sf):
    k = F.col("event_id") % 5
    error = F.when(k == 0, "x: DUPLICATE of 3").when(k == 1, "Duplikat").when(k == 2, "Zeit abgelaufen")
    return export.outcomes(B.table(spark, sf, "events").select(F.col("event_id").alias("local_id"), F.lit(1).alias("remote_id"), error.alias("error")))


@query(
    r"WITH RECURSIVE " + B.folders_sql(False) + r", w AS (SELECT id, list_filter(list_transform(string_split(replace(replace(keywords, ';', ','), chr(10), ','), ','), lambda k: lower(trim(k))), lambda k: k <> '') AS ks FROM fold), "
    r"r AS (SELECT id, array_to_string(list_transform(ks, lambda k: replace(replace(replace(replace(replace(k, 'ä', '(?:ä|ae)'), 'ö', '(?:ö|oe)'), 'ü', '(?:ü|ue)'), 'ß', '(?:ß|ss)'), ' ', '\s+')), '|') AS r FROM w) "
    r"SELECT id, CASE WHEN r = '' THEN '' ELSE '(?:' || r || ')' END AS pattern FROM r"
)
def keyword_regex(spark, sf):
    return B.folders(spark, sf, False).select("id", T.keyword_regex(T.split_keywords(F.col("keywords"))).alias("pattern"))


@query("WITH p AS (SELECT r_name || '/' || n_name AS p FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name FROM region UNION ALL SELECT 'Sonstiges') SELECT p || '/{{ created_year }}-{{ created_month }}-{{ created_day }}_{{ title }}' AS new, p || '/{created_year}-{created_month}-{created_day}_{title}' AS old FROM p")
def storage_template(spark, sf):
    paths = folders.folder_paths(B.folders(spark, sf, False))
    return paths.select(T.storage_template(F.col("path")).alias("new"), T.storage_template(F.col("path"), False).alias("old"))


_NOTE = "CASE WHEN notes <> '' THEN notes || chr(10) ELSE '' END || 'Betrag: ' || translate(format('{:,.2f}', amount), ',.', '.,') || ' €' || chr(10) || CASE WHEN iban IS NOT NULL THEN 'IBAN: ' || iban || chr(10) ELSE '' END || 'Übernommen aus dem Dokumentenarchiv (Nr. ' || id || ', ' || original_name || ')'"


@query(f"WITH {B.CATALOG} SELECT id, {_NOTE} AS note FROM cat")
def export_note(spark, sf):
    c = F.col
    return B.catalog(spark, sf).select("id", T.export_note(c("notes"), c("amount"), c("iban"), c("id"), c("original_name")).alias("note"))


@query(f"WITH {B.CATALOG} SELECT id, size FROM cat WHERE status = 'abgelegt' AND id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def export_pending(spark, sf):
    done = B.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("local_id"))
    return export.pending(B.catalog(spark, sf), done, include_inbox=False).select("id", "size")


@query(
    f"WITH {B.CATALOG} SELECT DISTINCT correspondent AS name FROM cat WHERE lower(correspondent) NOT IN ('müller src1', 'müller src2')"
)
def export_dimension(spark, sf):
    have = spark.range(1).select(F.explode(F.array(F.lit("MÜLLER src1"), F.lit("Müller SRC2"))).alias("name"))
    return export.dimension(B.catalog(spark, sf).select(F.col("correspondent").alias("name")), have)


@query(
    f"WITH {B.CATALOG} SELECT id, title, CAST(coalesce(doc_date, created_at) AS VARCHAR) AS created, CASE WHEN folder_id % 2 = 0 THEN folder_id + 5000 END AS correspondent_id, "
    "CASE doc_type WHEN 'Rechnung' THEN 1::BIGINT WHEN 'Vertrag' THEN 2 END AS document_type_id, CASE WHEN status = 'abgelegt' AND folder_id < 115 THEN folder_id * 10 END AS storage_path_id, "
    f"CASE WHEN size > 2000 THEN tags || '|6' ELSE tags END AS tag_names, status = 'eingang' AS inbox, {_NOTE} AS note FROM cat"
)
def export_payload(spark, sf):
    docs = B.catalog(spark, sf)
    types = spark.range(1).select(F.inline(F.array(F.struct(F.lit("Rechnung"), F.lit(1).cast("long")), F.struct(F.lit("Vertrag"), F.lit(2).cast("long")))).alias("name", "remote_id"))
    numbers = spark.range(100, 115).select(F.col("id").alias("folder_id"), (F.col("id") * 10).alias("remote_id"))
    senders = docs.where("folder_id % 2 = 0").select(F.col("correspondent").alias("name"), (F.col("folder_id") + 5000).alias("remote_id")).distinct()
    tagged = catalog.tags_of(B.document_tags(spark, sf), B.tags(spark, sf))
    remote = rows_of(spark, "name remote_id", ("en", 1), ("de", 2), ("fr", 3), ("es", 4), ("Lang", 6)).withColumn("remote_id", F.col("remote_id").cast("long"))
    out = export.payload(docs, numbers, types, senders, tagged, remote)
    back = F.create_map(*[F.lit(x) for kv in ((1, "en"), (2, "de"), (3, "fr"), (4, "es"), (6, "6")) for x in kv])
    return out.withColumn("tag_names", F.array_join(F.transform("tag_ids", lambda t: F.element_at(back, t.cast("int"))), "|")).drop("tag_ids")


# --------------------------------------------------------------------------- files


@query(
    "WITH c AS (" + SQL["clean_text"].replace("FROM pages)", "FROM pages WHERE page_id % 4 = 0)") + "), raw AS (" + SQL["clean_text"].replace(UNESCAPED, "html") + ") "
    "SELECT 'p' || p.page_id || ['.html', '.txt', '.xyz', '.docx'][p.page_id % 4 + 1] AS path, CASE p.page_id % 4 WHEN 0 THEN replace(c.text, chr(160), ' ') WHEN 1 THEN raw.text ELSE '' END AS text, "
    "CAST(1 AS INTEGER) AS pages, CASE WHEN p.page_id % 4 < 2 THEN 'text' ELSE 'none' END AS method, "
    "CASE p.page_id % 4 WHEN 2 THEN 'Dateityp .xyz wird nicht unterstützt' WHEN 3 THEN 'Text konnte nicht gelesen werden: File is not a zip file' ELSE '' END AS warnings "
    "FROM pages p LEFT JOIN c ON c.page_id = p.page_id JOIN raw ON raw.page_id = p.page_id"
)
def extract_files(spark, sf):
    """Pages as HTML files and under other endings, through the file parsers."""
    pages = B.table(spark, sf, "pages")
    kinds = F.array(*[F.lit(k) for k in (".html", ".txt", ".xyz", ".docx")])
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.get(kinds, (F.col("page_id") % 4).cast("int")))
    rows = sources.extract_files(pages.select(name.alias("path"), F.encode("html", "UTF-8").alias("content")))
    return rows.select("path", F.replace("text", F.lit("\u00a0"), F.lit(" ")).alias("text"), "pages", "method", F.array_join("warnings", "; ").alias("warnings"))


def _zip(*entries: tuple[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        for name, text in entries:
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


_W = 'xmlns:w="urn:w"'
_LONG_ODT = " ".join(f"Wort {k}" for k in range(400))
#: Small files of each kind, and their text.
SAMPLES = (
    ("a.docx", _zip(("word/document.xml", f"<w:document {_W}><w:p><w:t>Hallo</w:t><w:tab/><w:t>du</w:t></w:p><w:p><w:t>Welt</w:t></w:p></w:document>"), ("word/header1.xml", f"<w:hdr {_W}><w:p><w:t>Kopf</w:t></w:p></w:hdr>"), ("word/footnotes.xml", f"<w:f {_W}><w:p><w:t>Note</w:t></w:p></w:f>")), "Kopf\n\nHallo du\nWelt\n\nNote"),
    ("b.pptx", _zip(("ppt/slides/slide10.xml", f"<a {_W}><w:p><w:t>zehn</w:t></w:p></a>"), ("ppt/slides/slide2.xml", f"<a {_W}><w:p><w:t>zwei</w:t></w:p></a>")), "zwei\n\nzehn"),
    ("c.xlsx", _zip(("xl/workbook.xml", "<x/>"), ("xl/sharedStrings.xml", "<sst><si><t>Wort</t></si></sst>"), ("xl/worksheets/sheet1.xml", '<x><row><c t="s"><v>0</v></c><c><v>1.5</v></c></row><row><c t="inlineStr"><is><t>in</t></is></c></row></x>')), "Wort 1.5\nin"),
    ("d.odt", _zip(("mimetype", "application/vnd.oasis.opendocument.text"), ("content.xml", f'<o:x xmlns:o="o" xmlns:text="t"><text:h>Titel</text:h><text:p>a<text:s text:c="3"/>b<text:line-break/>{_LONG_ODT}</text:p></o:x>')), f"Titel\na b\n{_LONG_ODT}"),
    ("e.rtf", rb"{\rtf1{\fonttbl{\f0 Arial;}}{\*\gen x}Gr\'fc\u223?e\par Zeile zwei}", "Grüße\nZeile zwei"),
    ("f.eml", b"From: a@example.com\nSubject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\nContent-Type: text/html; charset=utf-8\n\n<p>Hi<br>du</p>", "From: a@example.com\nSubject: Grüße\n\nHi\ndu"),
    ("g.doc", b"\x00\x01" + "Hallo Welt".encode("utf-16le") + b"\xff\xfe", "Hallo Welt"),
    ("h.txt", "Ümlaut".encode("cp1252"), "Ümlaut"),
    ("i.md", b"\xef\xbb\xbfMarke\r\n\r\n\r\n\r\nEnde ", "Marke\n\nEnde"),
    ("j.HTM", "<style>x</style><p>Hallo &amp; Tsch&uuml;ss</p>".encode(), "Hallo & Tschüss"),
    ("k.docx", b"kaputt", ""),
    ("l.xyz", b"x", ""),
)


#: Those that get smaller.
PACKED = ("d.odt",)


def _samples(spark: SparkSession) -> DataFrame:
    rows = rows_of(spark, "path content", *[(n, base64.b64encode(c).decode()) for n, c, _ in SAMPLES])
    return rows.select("path", F.unbase64("content").alias("content"))


@query(f"SELECT * FROM (VALUES {', '.join(f'({quoted(n)}, {quoted(t)})' for n, _, t in SAMPLES)}) t(path, text)")
def parsed_files(spark, sf):
    return sources.extract_files(_samples(spark)).select("path", "text")


@query(f"SELECT * FROM (VALUES {', '.join(f'({quoted(n)}, {quoted(t)}, {str(n in PACKED).lower()})' for n, _, t in SAMPLES)}) t(path, text, smaller)")
def repacked_files(spark, sf):
    """The files packed again, read once more: nothing is lost, and the one that can be is smaller."""
    packed = sources.recompress(_samples(spark))
    smaller = F.col("stored_size") < F.col("size")
    again = sources.extract_files(packed.withColumn("less", smaller & (F.col("path").isin(*PACKED))))
    return again.select("path", "text", F.col("less").alias("smaller"))


@query(
    "WITH f AS (SELECT 'f' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || CASE WHEN doc_id % 7 = 0 THEN '.exe' WHEN doc_id % 7 = 1 THEN '.TXT' ELSE '.md' END AS path, doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents), "
    "known AS (SELECT sha256 FROM f WHERE doc_id % 10 = 3), first AS (SELECT sha256, min(path) AS path FROM f WHERE doc_id % 7 <> 0 GROUP BY sha256) "
    "SELECT f.path, CASE WHEN doc_id % 7 = 0 THEN 'Dateityp .exe wird nicht unterstützt' WHEN f.sha256 IN (SELECT sha256 FROM known) OR first.path <> f.path THEN 'bereits vorhanden' END AS error FROM f LEFT JOIN first ON first.sha256 = f.sha256"
)
def import_gate(spark, sf):
    k = F.col("doc_id") % 7
    name = F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.when(k == 0, ".exe").when(k == 1, ".TXT").otherwise(".md"))
    files = documents(spark, sf).select("doc_id", name.alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    accepted, rejected = sources.gate(files.select("path", "sha256"), files.where("doc_id % 10 = 3").select("sha256"))
    return accepted.select("path", F.lit(None).cast("string").alias("error")).unionByName(rejected.select("path", "error"))


_INVOICE = "Stadtwerke Musterstadt GmbH\nRechnung Nr. 5\nDatum: 14.03.2026\nZählerstand Strom\nRechnungsbetrag: 1.234,56 EUR"
#: Files of two import runs, and what becomes of them: text, kind, amount, or the reason why not.
IMPORTS = (
    (1, "a.txt", _INVOICE.encode(), _INVOICE, "Rechnung", 1234.56, None),
    (1, "b.txt", _INVOICE.encode(), None, None, None, "bereits vorhanden"),
    (1, "c.exe", b"x", None, None, None, "Dateityp .exe wird nicht unterstützt"),
    (1, "d.odt", SAMPLES[3][1], SAMPLES[3][2], None, None, None),
    (2, "e.md", _INVOICE.encode(), None, None, None, "bereits vorhanden"),
    (2, "f.eml", SAMPLES[5][1], SAMPLES[5][2], None, None, None),
)


def _null(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else quoted(v)


@query(
    f"SELECT run, name, text, doc_type, CAST(amount AS DOUBLE) AS amount, error FROM (VALUES {', '.join('(' + ', '.join(map(_null, (r[0], r[1], r[3], r[4], r[5], r[6]))) + ')' for r in IMPORTS)}) t(run, name, text, doc_type, amount, error) "
    "UNION ALL SELECT * FROM (VALUES (1, 'summary', 'imported 2, duplicates 1, errors 1', NULL, NULL, NULL), (2, 'summary', 'imported 1, duplicates 1, errors 0', NULL, NULL, NULL))"
)
def import_runs(spark, sf):
    """Two runs of the streaming import over a folder, and a third that finds nothing."""
    root = f"{shared_folder(spark)}/foliospark-steps/import-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for run in (1, 2, 3):
        for r in IMPORTS:
            if r[0] == run:
                out = system.create(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/landing/{r[1]}"))
                out.write(bytearray(r[2]))
                out.close()
        importer.start_import(spark, f"{root}/landing", f"{root}/store", as_of_year=AS_OF_YEAR).awaitTermination()
    name = F.regexp_extract("path", "([^/]*)$", 1).alias("name")
    read = lambda t, schema: importer.read_table(spark, f"{root}/store", t, schema)
    run = (F.col("batch") + 1).cast("int").alias("run")
    none = lambda kind: F.lit(None).cast(kind)
    done = read("documents", importer.STORE_SCHEMA).select(run, name, "text", "doc_type", "amount", none("string").alias("error"))
    refused = read("rejects", importer.REJECT_SCHEMA).select(run, name, none("string").alias("text"), none("string").alias("doc_type"), none("double").alias("amount"), "error")
    said = F.format_string("imported %d, duplicates %d, errors %d", "imported", "duplicates", "errors")
    totals = importer.summaries(spark, f"{root}/store").select(run, F.lit("summary").alias("name"), said.alias("text"), none("string").alias("doc_type"), none("double").alias("amount"), none("string").alias("error"))
    return done.unionByName(refused).unionByName(totals)


#: Remote files, what they are called here, and why not.
REMOTE = (
    ("Brief.v2.gdoc", "application/vnd.google-apps.document", "Brief.v2.pdf", None),
    ("Tabelle", "application/vnd.google-apps.spreadsheet", "Tabelle.pdf", None),
    ("Formular", "application/vnd.google-apps.form", None, "Formular: Google-Format application/vnd.google-apps.form kann nicht importiert werden"),
    ("Scan.PDF", "application/pdf", "Scan.PDF", None),
)


@query(f"SELECT * FROM (VALUES {', '.join('(' + ', '.join('NULL' if v is None else quoted(v) for v in (r[0], r[2], r[3])) + ')' for r in REMOTE)}) t(remote, name, error)")
def remote_names(spark, sf):
    name, error = sources.remote_name(F.col("remote"), F.col("kind"))
    return rows_of(spark, "remote kind", *[r[:2] for r in REMOTE]).select("remote", name.alias("name"), error.alias("error"))


@query(
    "SELECT 'f' || event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'a' || event_id || '.pdf' WHEN event_id % 3 = 1 THEN 'a' || event_id || '.txt' END AS file_name, event_id % 3 = 2 AS refused FROM events"
)
def remote_listing(spark, sf):
    """Events as files on pages of a hundred, the first of each page on the page before too."""
    k = F.col("event_id")
    kind = F.when(k % 3 == 0, "application/vnd.google-apps.document").when(k % 3 == 1, "text/plain").otherwise("application/vnd.google-apps.form")
    one = F.struct(F.concat(F.lit("f"), k.cast("string")).alias("id"), F.concat(F.lit("a"), k.cast("string"), F.lit(".txt")).alias("name"), kind.alias("mimeType"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("createdTime"))
    rows = B.table(spark, sf, "events").select(F.floor(k / 100).alias("no"), one.alias("file"), (k % 100 == 0).alias("first"))
    rows = rows.select("no", "file").unionByName(rows.where("first").select((F.col("no") - 1).alias("no"), "file"))
    pages = rows.groupBy("no").agg(F.collect_list("file").alias("files")).select(F.to_json(F.struct("files")).alias("page"))
    out = sources.remote_listing(pages.unionByName(rows_of(spark, "page", ("kaputt",), ("{}",))))
    return out.select("id", "file_name", F.col("error").isNotNull().alias("refused"))


@query(
    "SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN n_chars // 2 ELSE n_chars END AS stored_size, doc_id % 3 = 0 AND n_chars // 2 < n_chars AS replace FROM documents"
)
def recompressed_sizes(spark, sf):
    docs = documents(spark, sf)
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    present = docs.select(path.alias("path"), F.col("n_chars").alias("size"))
    # packed when a third had its present size, a third another one; the rest was not packed
    packed = docs.where("doc_id % 3 <> 2").select(path.alias("path"), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).otherwise(F.col("n_chars") + 1).alias("size"), F.floor(F.col("n_chars") / 2).alias("stored_size"))
    return sources.stored_sizes(present, packed)


@query("SELECT c_custkey AS id, CAST((c_custkey % 150 + 2 + 59) // 60 AS BIGINT) AS pages, c_name AS title, true AS whole FROM customer")
def text_pdf(spark, sf):
    """A PDF per customer with as many lines as its key says: its pages, its first line and its frame."""
    lines = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("c_custkey") % 150).cast("int")), lambda i: F.concat(F.lit("Zeile "), i.cast("string"))), "\n")
    docs = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 150 > 0, lines).otherwise(" ").alias("text"))
    pdf = F.decode("pdf", "ISO-8859-1")
    rows = sources.text_pdfs(docs)
    first = F.decode(F.unhex(F.regexp_extract(pdf, "<([0-9a-f]+)>Tj", 1)), "ISO-8859-1")
    return rows.select("id", F.regexp_count(pdf, F.lit("/Type/Page/")).cast("long").alias("pages"), first.alias("title"), (F.startswith(pdf, F.lit("%PDF-1.4")) & F.endswith(pdf, F.lit("%%EOF\n"))).alias("whole"))


@query("SELECT conv_id AS scan_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, CAST(count(*) AS INTEGER) AS pages FROM conversations GROUP BY conv_id")
def merge_scans(spark, sf):
    turns = B.table(spark, sf, "conversations")
    return sources.merge_scans(turns.select(F.col("conv_id").alias("scan_id"), F.col("turn").alias("no"), "text"))
