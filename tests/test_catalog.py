"""Catalogue, folders, terms, classification, search and export."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliospark.operators import catalog, classify, export, folders, search, terms

OUTLINE = """
* Rechnungen
* Wohnung
   * Musterstraße 12
* Pflanzen
* Versicherung
   * Krankenversicherung
      * AU
* pflanzen
   * Pflanzenpass
* A/B
"""


@pytest.fixture(scope="module")
def seed(spark):
    return folders.seed_folders(spark).cache()


def test_seed_paths_and_closure(spark, seed):
    paths = {r.path for r in folders.folder_paths(seed).collect()}
    assert len(paths) == 19 and "Wohnen / Energie" in paths
    assert folders.closure(seed).count() == 19 + 8
    assert folders.name_conflicts(seed, spark.createDataFrame([(None, "WOHNEN"), (None, "Neu")], "parent_id long, name string")).count() == 1


def test_outline(spark, seed):
    out = folders.parse_outline(spark.createDataFrame([(1, OUTLINE), (2, "\tA\n\t\tB\n- C\n1. D"), (3, None)], "outline_id long, text string"))
    paths = [tuple(r.path) for r in out.where("outline_id = 1 AND error IS NULL").orderBy("no").collect()]
    assert paths.count(("Pflanzen",)) == 1 and ("pflanzen", "Pflanzenpass") in paths and ("Versicherung", "Krankenversicherung", "AU") in paths
    assert out.where("outline_id = 1 AND error IS NOT NULL").count() == 1
    assert {tuple(r.path) for r in out.where("outline_id = 2").collect()} == {("A",), ("A", "B"), ("C",), ("D",)}
    health = seed.where("name = 'Gesundheit'").first().id
    filed = spark.createDataFrame([(1, health)], "doc_id long, folder_id long")
    diff = {r.path: r for r in folders.outline_diff(out.where("outline_id = 1 AND error IS NULL").select("path"), seed, filed).collect()}
    assert diff["Versicherung / Krankenversicherung / AU"].action == "create"
    assert diff["Gesundheit"].action == "keep_nonempty" and diff["Gesundheit"].documents == 1
    assert diff["Fahrzeuge"].action == "remove" and diff["Arbeit / Gehaltsabrechnungen"].action == "remove"


INVOICE = "Stadtwerke Musterstadt GmbH\nJahresabrechnung Strom 2025\nZählerstand alt: 12.345 kWh, Zählerstand neu\nAbschlag Rechnungsbetrag"
INSURANCE = "Musterversicherung AG\nVersicherungsschein Nr. 998877\nPrivathaftpflichtversicherung\nVersicherungsnehmer Jahresbeitrag"


def suggest(spark, seed, docs, filed):
    hits = classify.rule_hits(docs, seed)
    rules = classify.inherited_weights(classify.own_weights(hits, seed), seed)
    learned = classify.learned_scores(docs, filed.select("doc_id", "folder_id"))
    senders = classify.sender_votes(docs, filed)
    scores = classify.folder_scores(rules, learned, senders)
    return classify.suggestions(scores, seed, docs), classify.reasons(scores, hits, seed, docs)


def test_suggestions(spark, seed):
    docs = spark.createDataFrame([(1, INVOICE, "Stadtwerke"), (2, INSURANCE, "Muster"), (3, INSURANCE + " Kopie", "Muster"), (4, "xyz", None)], "doc_id long, text string, correspondent string")
    none = spark.createDataFrame([], "doc_id long, folder_id long, correspondent string")
    out, _ = suggest(spark, seed, docs, none)
    top = {r.doc_id: r.path for r in out.where("pos = 1").collect()}
    assert top[1] == "Wohnen / Energie" and top[2] == "Versicherungen"
    assert [(r.path, r.score) for r in out.where("doc_id = 4").collect()] == [("Sonstiges", 0.0)]
    contracts = seed.where("name = 'Verträge & Abos'").first().id
    filed = spark.createDataFrame([(2, contracts, "muster")], "doc_id long, folder_id long, correspondent string")
    out, why = suggest(spark, seed, docs, filed)
    assert out.where("doc_id = 3 AND pos = 1").first().path == "Verträge & Abos"
    reasons = why.where(f"doc_id = 3 AND folder_id = {contracts}").first().reasons
    assert any("1× von Muster" in r for r in reasons)


def test_learning_and_unlearning_is_identity(spark):
    docs = spark.createDataFrame([(1, INVOICE), (2, INSURANCE)], "doc_id long, text string")
    tf = terms.term_frequency(docs)
    profile = terms.folder_terms(tf, spark.createDataFrame([(1, 5)], "doc_id long, folder_id long"))
    more = terms.folder_terms(tf, spark.createDataFrame([(2, 5), (1, 5)], "doc_id long, folder_id long"))
    back = terms.apply_delta(terms.apply_delta(profile, more), more.withColumn("count", -F.col("count")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, profile.collect()))


def test_search(spark, tmp_path):
    rows = [(1, "Rechnung", "Stadtwerke", "", INVOICE), (2, "Brief", "Dr. Beispiel", "arzt", "Physiotherapie in der Straße"), (3, "leer", None, None, None)]
    docs = spark.createDataFrame(rows, "id long, title string, correspondent string, tags string, text string")
    ids = lambda q: [r.id for r in search.bm25(docs, q).collect()]
    assert ids("zählerst") == [1] and ids("ZAHLERST") == [1] and ids("zaehlerst") == []
    assert ids("physiotherapie straß") == [2] and ids("strasse") == [] and ids('" (') == [1, 2, 3]
    plain = {r.id: round(r.score, 9) for r in search.bm25(docs, "st").collect()}
    index = search.build_index(docs)
    assert plain.keys() == {1, 2} and {r.id: round(r.score, 9) for r in search.bm25_indexed(index, "st").collect()} == plain
    assert {r.id: r.score for r in search.bm25_indexed(index, "").collect()} == {1: 0, 2: 0, 3: 0}
    search.write_index(index, str(tmp_path))
    index = search.read_index(spark, str(tmp_path))
    wordless = docs.unionByName(spark.createDataFrame([(4, None, None, None, "..."), (5, "Post", None, None, "Stuhl Stift")], docs.schema))
    want = {r.id: round(r.score, 9) for r in search.bm25(wordless, "st").collect()}
    grown = search.upserted_index(index, wordless.where("id > 2"))
    assert {r.id: round(r.score, 9) for r in search.bm25_indexed(grown, "st").collect()} == want
    assert {r.id for r in search.bm25_indexed(search.dropped_from_index(grown, docs.where("id = 1")), "st").collect()} == {2, 5}
    shown = docs.where("id = 1").select(search.snippet(F.col("text"), "zähler", mark=("[", "]"))).first()[0]
    assert "[Zählerstand]" in shown


CATALOG = "id long, title string, original_name string, status string, folder_id long, correspondent string, size long, stored_size long, doc_type string, doc_date date, created_at date, amount double, iban string, notes string, sha256 string"


def entry(i, title="Titel", status="abgelegt", folder=6, size=10, stored=None, sha=None):
    return (i, title, f"datei{i}.PDF", status, folder, "Sender", size, stored, "Rechnung", None, None, 1.5, None, "", sha or f"h{i}")


def test_filing_and_stats(spark, seed):
    energy = seed.where("name = 'Energie'").first().id
    docs = spark.createDataFrame([entry(1, "Strom/2025", folder=energy), entry(2, "Strom 2025", folder=energy), entry(3, status="eingang")], CATALOG)
    docs = docs.withColumn("created_at", F.lit("2026-03-14").cast("date"))
    paths = {r.id: r.path for r in catalog.filing_paths(docs, seed).collect()}
    assert paths == {1: "Wohnen/Energie/2026-03-14_Strom 2025.pdf", 2: "Wohnen/Energie/2026-03-14_Strom 2025 (2).pdf"}
    stats = catalog.stats(docs).first()
    assert (stats.inbox, stats.filed, stats.bytes_original, stats.optimize_pending) == (1, 2, 30, 3)
    empty = catalog.stats(docs.limit(0)).first()
    assert (empty.inbox, empty.bytes_stored, empty.saved_percent) == (0, 0, 0.0)


def test_changes(spark):
    docs = spark.createDataFrame([entry(1), entry(2), entry(3)], CATALOG)
    patch = spark.createDataFrame([(1, None, None, "12,50", None), (2, "  ", None, None, None), (3, "neu", "22.02.", None, "x")], "id long, title string, doc_date string, amount string, notes string")
    got = {r.id: r for r in catalog.patched(docs, patch).collect()}
    assert got[1].amount == 12.5 and got[1].error is None
    assert got[2].error == "Titel darf nicht leer sein" and got[3].error == "Datum bitte als JJJJ-MM-TT" and got[3].title == "Titel"
    new = spark.createDataFrame([entry(None, sha="h1"), entry(None, "neu", sha="n1"), entry(None, "neu", sha="n1")], CATALOG).drop("id")
    both = catalog.inserted(docs, new)
    assert both.count() == 4 and both.select("id").distinct().count() == 4
    last = catalog.upserted(spark.createDataFrame([("a", 1, "alt")], "key string, v int, x string"), spark.createDataFrame([("a", 1, "neu"), ("b", 0, "b")], "key string, v int, x string"), "key", "v")
    assert {(r.key, r.x) for r in last.collect()} == {("a", "neu"), ("b", "b")}


def test_tags_and_deletion(spark):
    docs = spark.createDataFrame([entry(1), entry(2)], CATALOG)
    tags = spark.createDataFrame([(1, "a"), (2, "B"), (3, "weg")], "id long, name string")
    bridge = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "document_id long, tag_id long")
    assert {r.document_id: r.tags for r in catalog.tags_of(bridge, tags).collect()} == {1: ["a", "B"], 2: ["a"]}
    rest, left, names = catalog.deleted(docs, bridge, tags, spark.createDataFrame([(1,)], "id long"))
    assert rest.count() == 1 and left.count() == 1 and [r.name for r in names.collect()] == ["a"]
    raw = spark.createDataFrame([(1, 0, " Foo "), (1, 1, "foo"), (1, 2, "#BAR;"), (1, 3, " ,;")], "document_id long, pos int, name string")
    got = catalog.normalise_tags(raw, spark.createDataFrame([("bar",)], "name string"))
    assert sorted(r.name for r in got.collect()) == ["Foo", "bar"]


def test_export_plan(spark):
    docs = spark.createDataFrame([entry(1), entry(2, status="eingang"), entry(3)], CATALOG)
    done = spark.createDataFrame([(1,)], "local_id long")
    assert sorted(r.id for r in export.pending(docs, done).collect()) == [2, 3]
    assert [r.id for r in export.pending(docs, done, include_inbox=False).collect()] == [3]
    assert export.document_types(docs).count() == 18
    results = spark.createDataFrame([(1, 7, None), (2, None, "It is a duplicate of 4"), (3, None, "kaputt")], "local_id long, remote_id long, error string")
    assert tuple(export.outcomes(results).first()) == (1, 1, 1)
    tasks = spark.createDataFrame([('{"related_document": "12"}',), ('{"result": "Success. New document id 9 created"}',), ("{}",)], "t string")
    assert [r[0] for r in tasks.select(export.task_document(F.col("t"))).collect()] == [12, 9, None]
