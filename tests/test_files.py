"""File parsers, writers and the streaming import, on files made here."""

from __future__ import annotations

import io
import re
import zipfile

import pytest

from foliospark.operators import folders
from foliospark.sources import files as S
from foliospark.streaming import importer

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def zipped(entries, stored=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            z.writestr(name, data, zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED, 1)
    return out.getvalue()


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    return zipped([("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>"), ("word/header1.xml", f"<w:hdr {W}><w:p><w:r><w:t>Kopf</w:t><w:tab/></w:r></w:p></w:hdr>")])


def odt(*paragraphs):
    t = "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
    body = "".join(f"<text:p>{p}</text:p>" for p in paragraphs)
    return zipped([("mimetype", "application/vnd.oasis.opendocument.text"), ("content.xml", f'<office:x xmlns:office="o" xmlns:text="{t}">{body}</office:x>')], stored=("mimetype",))


def xlsx():
    sheet = '<x><row><c t="s"><v>0</v></c><c><v>1.5</v></c></row><row><c t="inlineStr"><is><t>in</t></is></c></row></x>'
    return zipped([("xl/workbook.xml", "<x/>"), ("xl/sharedStrings.xml", "<sst><si><t>Wort</t></si></sst>"), ("xl/worksheets/sheet2.xml", sheet), ("xl/worksheets/sheet1.xml", "<x><row><c><v>7</v></c></row></x>")])


def test_parsers():
    got = lambda name, data: S.extract(name, data).text
    assert got("a.docx", docx("Hallo", "Welt")) == "Kopf\n\nHallo\nWelt"
    assert got("a.odt", odt("Grüße", 'a<text:s text:c="2"/>b<text:tab/>c')) == "Grüße\na b c"
    assert got("a.xlsx", xlsx()) == "7\n\nWort 1.5\nin"
    assert got("a.pptx", zipped([("ppt/slides/slide10.xml", f"<a {W}><w:p><w:t>zehn</w:t></w:p></a>"), ("ppt/slides/slide2.xml", f"<a {W}><w:p><w:t>zwei</w:t></w:p></a>")])) == "zwei\n\nzehn"
    assert got("a.HTML", "<style>x</style><p>Hallo &amp; Tsch&uuml;ss</p>".encode()) == "Hallo & Tschüss"
    assert got("a.rtf", rb"{\rtf1{\fonttbl{\f0 Arial;}}{\*\gen x}Gr\'fc\u223?e\par Zeile zwei}") == "Grüße\nZeile zwei"
    assert got("a.eml", b"From: a@example.com\nSubject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\nContent-Type: text/html; charset=utf-8\n\n<p>Hi<br>du</p>") == "From: a@example.com\nSubject: Grüße\n\nHi\ndu"
    assert got("a.doc", b"\x00\x01" + "Hallo Welt".encode("utf-16le") + b"\xff\xfe") == "Hallo Welt"
    assert got("a.txt", "Ümlaut".encode("cp1252")) == "Ümlaut" and got("a.txt", b"\xef\xbb\xbfx") == "x" and got("a.txt", b"\x81\x8d") == "\x81\x8d"


def test_broken_and_unknown_files():
    assert S.extract("a.exe", b"x").method == "none"
    assert "nicht gelesen" in S.extract("a.docx", b"kaputt").warnings[0]
    assert S.extract("a.txt", b" ").warnings == ["Kein Text gefunden"]
    assert S.extract("noending", b"x").warnings and S.extract("a.pdf", b"x").method == "none" and S.extract("a.png", b"x").method == "none"


def test_lossless_zip():
    data = odt("viel Text " * 500)
    small = S.repack_zip(data)
    assert len(small) < len(data) and zipfile.ZipFile(io.BytesIO(small)).infolist()[0].compress_type == zipfile.ZIP_STORED
    assert S.extract("a.odt", small).text == S.extract("a.odt", data).text
    assert S.repack_zip(small) == small


def test_recompress_keeps_broken_files(spark):
    df = spark.createDataFrame([("a.odt", bytearray(odt("x " * 900))), ("b.docx", bytearray(b"kaputt")), ("c.txt", bytearray(b"t"))], "path string, content binary")
    got = {r.path: r.stored_size for r in S.recompress(df).collect()}
    assert got["b.docx"] == 6 and got["c.txt"] == 1 and got["a.odt"] < len(odt("x " * 900))


def test_text_pdf():
    pdf = S.text_pdf("Titel (1)", "Grüße € \\ " + "wort " * 2000)
    assert pdf.startswith(b"%PDF-1.4") and pdf.rstrip().endswith(b"%%EOF") and "Titel (1)".encode().hex().encode() in pdf and "Grüße €".encode("cp1252").hex().encode() in pdf
    assert pdf.count(b"/Type/Page/") > 1 and b"/Count %d/" % pdf.count(b"/Type/Page/") in pdf
    for number, at in enumerate(re.findall(rb"(\d{10}) 00000 n", pdf), 1):
        assert pdf[int(at) :].startswith(b"%d 0 obj" % number)
    start = int(pdf.rsplit(b"startxref\n", 1)[1].split()[0])
    assert pdf[start:].startswith(b"xref")
    assert b"kein Text erkannt".hex().encode() in S.text_pdf("x", None)


def test_gate(spark):
    rows = [("a.txt", "h1"), ("b.txt", "h1"), ("c.exe", "h2"), ("d.txt", "h3"), ("e.txt", "h4")]
    known = spark.createDataFrame([("h3",)], "sha256 string")
    ok, no = S.gate(spark.createDataFrame(rows, "path string, sha256 string"), known)
    assert {r.path for r in ok.collect()} == {"a.txt", "e.txt"}
    assert {r.path: r.error for r in no.collect()} == {"b.txt": "bereits vorhanden", "c.exe": "Dateityp .exe wird nicht unterstützt", "d.txt": "bereits vorhanden"}


def test_streaming_import(spark, tmp_path):
    landing, store = tmp_path / "in", str(tmp_path / "store")
    landing.mkdir()
    (landing / "a.docx").write_bytes(docx("Hallo"))
    (landing / "b.html").write_text("<p>Welt</p>")
    (landing / "c.exe").write_bytes(b"x")
    importer.start_import(spark, str(landing), store).awaitTermination()
    assert [tuple(r)[1:] for r in importer.summaries(spark, store).select("batch", "imported", "duplicates", "errors").collect()] == [(2, 0, 1)]
    importer.start_import(spark, str(landing), store).awaitTermination()
    assert importer.summaries(spark, store).count() == 1  # nothing new, no batch
    (landing / "again.docx").write_bytes((landing / "a.docx").read_bytes())
    importer.start_import(spark, str(landing), store).awaitTermination()
    total = importer.summaries(spark, store).groupBy().sum("imported", "duplicates", "errors").first()
    assert tuple(total) == (2, 1, 1)
    texts = importer.read_table(spark, store, "documents", importer.STORE_SCHEMA).collect()
    assert {r.text for r in texts} == {"Kopf\n\nHallo", "Welt"}


INVOICE = "Stadtwerke Musterstadt GmbH\nRechnung Nr. 5\nDatum: 14.03.2026\nZählerstand Strom kwh Abschlag\nRechnungsbetrag: 1.234,56 EUR\n"


def test_import_analyses_and_moves_files(spark, tmp_path):
    landing, store, archive = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "importiert")
    landing.mkdir()
    (landing / "a.txt").write_text(INVOICE)
    (landing / "c.exe").write_bytes(b"x")
    tree = folders.seed_folders(spark)
    importer.start_import(spark, str(landing), store, archive=archive, as_of_year=2026, folders=tree).awaitTermination()
    (landing / "b.txt").write_text(INVOICE.replace("1.234,56", "7,00"))
    importer.start_import(spark, str(landing), store, archive=archive, as_of_year=2026, folders=tree).awaitTermination()
    rows = {r.path.rsplit("/", 1)[1]: r for r in importer.read_table(spark, store, "documents", importer.STORE_SCHEMA).collect()}
    assert (rows["a.txt"].doc_type, str(rows["a.txt"].doc_date), rows["a.txt"].amount, rows["a.txt"].title) == ("Rechnung", "2026-03-14", 1234.56, "Rechnung Stadtwerke Musterstadt")
    tags = importer.read_table(spark, store, "tags", importer.TAG_SCHEMA).where("pos = 0").collect()
    assert [t.name for t in tags] == ["Rechnung", "Rechnung"]
    df = {r.term: r.df for r in importer.document_frequency(spark, store).collect()}
    assert df["zaehlerstand"] == 2 and "datum" not in df
    best = importer.read_table(spark, store, "suggestions", importer.SUGGESTION_SCHEMA).where("pos = 1").collect()
    assert {r.path for r in best} == {"Wohnen / Energie"}
    assert sorted(p.name for p in landing.iterdir()) == ["c.exe"] and sorted(p.name for p in (tmp_path / "importiert").iterdir() if not p.name.startswith(".")) == ["a.txt", "b.txt"]


def test_a_second_start_is_refused(spark, tmp_path):
    landing, store = tmp_path / "in", str(tmp_path / "store")
    landing.mkdir()
    first = importer.start_import(spark, str(landing), store, minutes=1)
    with pytest.raises(RuntimeError):
        importer.start_import(spark, str(landing), store)
    first.stop()


def test_other_columns_pass_the_parsers(spark):
    df = spark.createDataFrame([("a.txt", bytearray(b"x"), 7, ["k"])], "path string, content binary, size long, marks array<string>")
    assert [tuple(r) for r in S.extract_files(df).select("path", "size", "marks", "text").collect()] == [("a.txt", 7, ["k"], "x")]


def test_nested_paragraphs_and_mail_parts():
    t = "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
    body = '<text:p>vor<text:note>1<text:p>Fuß<text:line-break/>note</text:p></text:note>nach</text:p><text:h>K<text:span>opf</text:span></text:h>'
    data = zipped([("content.xml", f'<o:x xmlns:o="o" xmlns:text="{t}">{body}</o:x>')])
    assert S.extract("a.odt", data).text == "vornach\nFuß\nnote\nKopf"
    mail = b'Subject: S\nTo: b@example.com\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="B"\n\n--B\nContent-Type: text/html\n\n<p>eins</p>\n--B\nContent-Type: text/plain\n\nzwei\n--B\nContent-Type: text/plain\nContent-Disposition: attachment\n\ndrei\n--B--\n'
    assert S.extract("a.eml", mail).text == "To: b@example.com\nSubject: S\n\nzwei"
