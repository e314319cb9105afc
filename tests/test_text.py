"""Text functions on the fixtures' expected values, and as properties against plain Python."""

from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.sources.files import strip_markup


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@settings(max_examples=5, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aäÄößÜéÈñŁ \t\n-_.,;#/1²ﬁＡ½…Ⅷ\u0308\u00a0", max_size=30), min_size=1, max_size=20))
def test_norm_is_exact_on_latin_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for r in df.select("x", T.norm(F.col("x")).alias("n"), T.tokens(F.col("x")).alias("t")).collect():
        assert r.n == T.norm_py(r.x) and r.t == re.findall(r"[^\W_]+", r.n)


@pytest.mark.parametrize("name,want", [("a/b:c*", "a b c"), (" . ", "Dokument"), ("x" * 200, "x" * 120), ("Ä  b\tc.", "Ä b c"), ("", "Dokument")])
def test_safe_filename(spark, name, want):
    assert one(spark, name, T.safe_filename) == want


def test_keywords(spark):
    assert one(spark, "A; b\nA, ,c", T.split_keywords) == ["A", "b", "A", "c"]
    assert one(spark, "A; b\na, ,c", T.clean_keywords) == "a, b, c"
    pattern = one(spark, "versicherung, zählerstand, kfz-steuer, steuer id", lambda c: T.keyword_regex(T.split_keywords(c)))
    for found in ("Haftpflichtversicherung", "Zaehlerstand", "Zählerstand", "KFZ Steuer", "Steuer  ID"):
        assert re.search(pattern, found.lower())
    assert not re.search(pattern, "rechnung")
    assert one(spark, "", lambda c: T.keyword_regex(T.split_keywords(c))) == ""


def test_folder_names(spark):
    cases = {"  A  b ": ("A b", None), "": (None, "Ordnername fehlt"), "a/b": (None, "Ungültiger Ordnername"), "eingang": (None, "Ungültiger Ordnername"), "..": (None, "Ungültiger Ordnername")}
    for name, want in cases.items():
        got = spark.createDataFrame([(name,)], "x string").select(*T.folder_name(F.col("x"))).first()
        assert tuple(got) == want
    for name, want in {"Verträge": "vertrag, arbeitsvertrag", "Vater": "", "AB": "", "Musterstraße 12": "musterstraße 12"}.items():
        assert one(spark, name, T.suggest_folder_keywords).startswith(want)


def test_html_and_cleaning(spark):
    source = "<head><title>x</title></head><style>p{}</style><p>Hallo &amp; Tsch&uuml;ss</p><script>1</script>"
    assert one(spark, source, lambda c: T.clean_text(T.html_to_text(c))) == "Hallo & Tschüss"
    assert one(spark, "&hearts;<br>b", lambda c: T.clean_text(T.html_to_text(c))) == "♥\nb"
    assert one(spark, "a \t b\r\n\n\n\n c\x00 ", T.clean_text) == "a b\n\nc"


def test_entities_cut_off_before_their_semicolon(spark):
    """As HTML 5 and html.unescape have it: names of the old list need no semicolon, others and parts of names stay."""
    source = "<h1>a&amp;&amp</h1>&copy x &am</p>"
    assert one(spark, source, T.html_to_text) == " a&&\n© x &am\n"
    assert strip_markup(source) == " a&&\n© x &am\n"


def test_export_texts(spark):
    assert one(spark, "Wohnen / Energie", T.storage_template) == "Wohnen/Energie/{{ created_year }}-{{ created_month }}-{{ created_day }}_{{ title }}"
    assert one(spark, "A", lambda c: T.storage_template(c, False)) == "A/{created_year}-{created_month}-{created_day}_{title}"
    note = one(spark, "x.pdf", lambda c: T.export_note(F.lit("n"), F.lit(1234.56), F.lit(None).cast("string"), F.lit(3), c))
    assert note == "n\nBetrag: 1.234,56 €\nÜbernommen aus dem Dokumentenarchiv (Nr. 3, x.pdf)"


def test_prefix_terms():
    assert T.prefix_terms('" OR (') == ["or"]
    assert T.prefix_terms("Zählerst, foo_bar") == ["zahlerst", "foo", "bar"]
    assert T.prefix_terms("-- !") == []
