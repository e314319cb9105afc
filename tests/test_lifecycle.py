"""A document's life: filed, corrected, filed anew, deleted; every table follows."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import catalog, folders, lifecycle, search, terms

DOCS = "id long, title string, original_name string, status string, folder_id long, correspondent string, doc_date date, created_at date, amount double, notes string, text string"


def test_filing_correcting_and_deleting(spark):
    tree = folders.seed_folders(spark)
    place = {r.name: r.id for r in tree.collect()}
    rows = [
        (1, "Strom", "a.PDF", "eingang", None, "Werk", None, None, None, "", "Zählerstand Strom Strom"),
        (2, "Strom", "b.pdf", "abgelegt", place["Energie"], "Werk", None, None, None, "", "Abschlag Strom"),
        (3, "Police", "c.pdf", "abgelegt", place["Versicherungen"], None, None, None, None, "", "Police Haftpflicht"),
    ]
    docs = spark.createDataFrame(rows, DOCS).withColumn("created_at", F.lit("2025-01-02").cast("date"))
    tags = spark.createDataFrame([(1, "gelb"), (2, "nur drei")], "id long, name string")
    bridge = spark.createDataFrame([(1, 1), (3, 1), (3, 2)], "document_id long, tag_id long")
    tf = terms.term_frequency(docs, "id", "text")
    filed = docs.where("status = 'abgelegt'").select("id", "folder_id")
    library = lifecycle.Library(docs, bridge, tags, terms.folder_terms(tf, filed, "id"), terms.document_frequency(tf), search.build_index(lifecycle.with_tag_names(docs, bridge, tags)))

    def learned(lib):
        return {(r.folder_id, r.term): r["count"] for r in lib.profile.collect()}

    def found(lib, q):
        return sorted(r.id for r in search.bm25_indexed(lib.index, q).collect())

    one, moved = lifecycle.file(library, spark.createDataFrame([(1, place["Energie"])], "id long, folder_id long"), tree)
    assert learned(one)[place["Energie"], "strom"] == 3 and one.docs.where("id = 1").first().status == "abgelegt"
    assert {(r.id, r.old, r.new) for r in moved.collect()} == {(1, None, "Wohnen/Energie/2025-01-02_Strom.pdf"), (2, "Wohnen/Energie/2025-01-02_Strom.pdf", "Wohnen/Energie/2025-01-02_Strom (2).pdf")}

    two, moved = lifecycle.file(one, spark.createDataFrame([(2, place["Steuern"])], "id long, folder_id long"), tree)
    assert learned(two)[place["Energie"], "strom"] == 2 and learned(two)[place["Steuern"], "abschlag"] == 1 and (place["Energie"], "abschlag") not in learned(two)
    assert [(r.id, r.new) for r in moved.collect()] == [(2, "Finanzen/Steuern/2025-01-02_Strom.pdf")]

    patch = spark.createDataFrame([(1, "Jahresabrechnung", "2026-02-03", "12,5", None), (3, " ", None, None, None)], "id long, title string, doc_date string, amount string, notes string")
    three, moved, errors = lifecycle.update(two, patch, tree)
    assert [(r.id, r.new) for r in moved.collect()] == [(1, "Wohnen/Energie/2026-02-03_Jahresabrechnung.pdf")]
    assert [r.id for r in errors.collect()] == [3] and found(three, "jahresab") == [1] and found(three, "gelb") == [1, 3] and found(two, "jahresab") == []

    four, files, emptied = lifecycle.delete(three, spark.createDataFrame([(3,)], "id long"), tree)
    assert [r.path for r in files.collect()] == ["Versicherungen/2025-01-02_Police.pdf"] and [r.path for r in emptied.collect()] == ["Versicherungen"]
    assert [r.name for r in four.tags.collect()] == ["gelb"] and found(four, "haftpf") == [] and found(four, "") == [1, 2]
    assert "police" not in {r.term for r in four.df.collect()} and not {k for k in learned(four) if k[0] == place["Versicherungen"]}
    assert {r.term: r.df for r in four.df.collect()}["strom"] == 2


def test_cycles_end(spark):
    loop = spark.createDataFrame([(1, 2, "a", ""), (2, 1, "b", ""), (3, None, "c", ""), (4, 3, "d", "")], "id long, parent_id long, name string, keywords string")
    assert {r.id: r.path for r in folders.folder_paths(loop).collect()} == {3: "c", 4: "c / d"}
    assert sorted(r.id for r in folders.subtree(loop, 1).collect()) == [1, 2] and sorted(r.id for r in folders.subtree(loop, 3).collect()) == [3, 4]


def test_setting_and_points(spark):
    rows = spark.createDataFrame([("a", "1")], "key string, value string")
    assert [r.value for r in catalog.setting(rows, "a").collect()] == ["1"] and catalog.setting(rows, "b").count() == 0
