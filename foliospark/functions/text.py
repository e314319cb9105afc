"""Text functions as column expressions, and exact Arrow variants where Spark has no built-in.

Java's \\w is ASCII only, so words are [\\p{L}\\p{N}]+ throughout.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliospark.functions.reference_data import FOLDER_KEYWORDS, STOPWORDS, TOO_GENERIC

WORD = r"[\p{L}\p{N}]+"


def _accents() -> tuple[str, str]:
    """Accented lower-case Latin letters and their base letters, by Unicode's own decomposition."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code).lower()
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(c) == 1 and len(base) == 1 and base != c:
            pairs.append((c, base))
    pairs = sorted(set(pairs))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


ACCENTED, BASES = _accents()


# How umlauts are written out.
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))
DECOMPOSED = tuple((unicodedata.normalize("NFD", u), w) for u, w in UMLAUTS[:3])


def norm_py(text: str) -> str:
    """The definition of norm."""
    text = unicodedata.normalize("NFKC", text).lower()
    for umlaut, letters in UMLAUTS:
        text = text.replace(umlaut, letters)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _ranges(codes: list[int]) -> str:
    """A pattern class of code points."""
    out, k = [], 0
    while k < len(codes):
        j = k
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"\\x{{{codes[k]:X}}}" + (f"-\\x{{{codes[j]:X}}}" if j > k else ""))
        k = j + 1
    return "[" + "".join(out) + "]"


def _compatibility() -> tuple[tuple[str, str], dict[str, str], str, str]:
    """By Unicode's own tables: letters whose norm is one other character, those whose norm is several, their pattern class, and that of
    combining marks. Hangul syllables, which only come apart into their letters, stay as they are.
    """
    single, several, marks = [], {}, []
    planes = [*range(0x80, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200), *range(0x2F800, 0x2FA20)]
    for code in planes:
        c = chr(code)
        if unicodedata.combining(c):
            marks.append(code)
            continue
        exact = norm_py(c)
        if exact == c or len(c.lower()) != 1 or c in "äöüß":
            continue
        if len(exact) == 1 and code < 0x10000:
            single.append((c, exact))
        elif exact:
            several[c] = exact
    return ("".join(x for x, _ in single), "".join(x for _, x in single)), several, _ranges(sorted(map(ord, several))), _ranges(marks)


(SINGLE, SINGLE_BASES), SEVERAL, SEVERAL_CLASS, MARKS = _compatibility()
#: Those of them that are another form of the same letter: full-width, raised, ...
FORMS = "".join(c for c, b in zip(SINGLE, SINGLE_BASES) if unicodedata.normalize("NFKC", c).lower() == b)
FORM_BASES = "".join(b for c, b in zip(SINGLE, SINGLE_BASES) if c in FORMS)


def _ordinary() -> str:
    """A short class of the letters and signs of European texts that umlauts written out and accents dropped are all of norm for."""

    def quick(c: str) -> str:
        for umlaut, letters in UMLAUTS:
            c = c.lower().replace(umlaut, letters)
        return c.translate(str.maketrans(ACCENTED, BASES))

    codes = [*range(0x80), *range(0xA0, 0x180), *range(0x2010, 0x2040), 0x20AC]
    return _ranges([c for c in codes if quick(chr(c)) == norm_py(chr(c)) and not unicodedata.combining(chr(c))])


ORDINARY = _ordinary()


def _constant_map(pairs: dict[str, str]) -> Column:
    """A map out of one literal, which the optimizer folds once; no key or value holds the two control characters."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in pairs.items())), F.lit("\x01"), F.lit("\x02"))


def _ascii_fast(text: Column, rest: Callable[[Column], Column]) -> Column:
    """Lower-cased text; only texts with letters beyond ASCII take the slow steps of rest."""
    low = F.lower(text)
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(rest(low))


def fold(text: Column) -> Column:
    """Lower-cased without diacritics: what the search index compares (ä is a, ß stays)."""
    return _ascii_fast(text, lambda t: F.regexp_replace(F.translate(t, ACCENTED, BASES), r"\p{Mn}+", ""))


def norm(text: Column) -> Column:
    """Compatibility forms resolved, lower-cased, umlauts written out, other diacritics dropped (ä is ae, é is e, ﬁ is fi)."""

    def written(t: Column) -> Column:
        t = F.translate(t, FORMS, FORM_BASES)  # first, as marks may follow
        for umlaut, letters in (*UMLAUTS, *DECOMPOSED, ("…", "...")):
            t = F.replace(t, F.lit(umlaut), F.lit(letters))
        return F.regexp_replace(F.translate(t, SINGLE, SINGLE_BASES), MARKS, "")

    def resolved(t: Column) -> Column:
        # the few texts with a letter that becomes several, letter by letter
        table = _constant_map(SEVERAL)
        each = F.transform(F.regexp_extract_all(t, F.lit("(?s)(.)"), F.lit(1)), lambda c: F.coalesce(F.try_element_at(table, c), c))
        return F.array_join(each, "")

    def plain(t: Column) -> Column:
        for umlaut, letters in UMLAUTS:
            t = F.replace(t, F.lit(umlaut), F.lit(letters))
        return F.translate(t, ACCENTED, BASES)

    def beyond_ascii(t: Column) -> Column:
        rare = F.when(t.rlike(SEVERAL_CLASS), written(resolved(t))).otherwise(written(t))
        return F.when(~t.rlike("[^" + ORDINARY[1:]), plain(t)).otherwise(rare)

    return _ascii_fast(text, beyond_ascii)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def tokens(text: Column) -> Column:
    """All normalised words."""
    return words(norm(text))


def is_content_word(token: Column, stopwords: list[str] = STOPWORDS) -> Column:
    return (F.length(token) >= 3) & ~token.isin(stopwords) & ~token.rlike(r"\p{Nd}")


def content_tokens(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    return F.filter(tokens(text), lambda t: is_content_word(t, stopwords))


def surface_words(text: Column) -> Column:
    """array of (term, form): the normalised word and how it is written."""
    pairs = F.transform(words(text), lambda w: F.struct(norm(w).alias("term"), w.alias("form")))
    return F.filter(pairs, lambda p: p["term"] != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _strip(text: Column, chars: str) -> Column:
    return F.btrim(text, F.lit(chars))


def _composed() -> list[tuple[str, str, str]]:
    """Latin letters with the marks of European languages, and what they are as one character, by Unicode's own tables."""
    out = []
    for mark in map(chr, (0x300, 0x301, 0x302, 0x303, 0x304, 0x306, 0x307, 0x308, 0x30A, 0x30B, 0x30C, 0x327, 0x328)):
        for letter in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
            joined = unicodedata.normalize("NFC", letter + mark)
            if len(joined) == 1:
                out.append((letter, mark, joined))
    return out


COMPOSED = _composed()


def safe_filename(name: Column, max_len: int = 120) -> Column:
    """A title as a file name; 'Dokument' if nothing is left."""
    table = _constant_map({letter + mark: joined for letter, mark, joined in COMPOSED})
    parts = F.regexp_extract_all(name, F.lit(r"(?s)([A-Za-z][\x{300}-\x{328}]|.)"), F.lit(1))
    composed = F.array_join(F.transform(parts, lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    name = F.when(name.rlike(r"[A-Za-z][\x{300}-\x{328}]"), composed).otherwise(name)
    out = F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1f]', " ")
    out = _strip(F.regexp_replace(out, r"\s+", " "), " .")
    out = F.rtrim(F.substring(out, 1, max_len), F.lit(" ."))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("Dokument"))


def split_keywords(raw: Column) -> Column:
    """Keywords separated by comma, semicolon or newline, trimmed, without empty ones."""
    parts = F.transform(F.split(F.translate(raw, ";\n", ",,"), ","), lambda k: F.trim(k))
    return F.filter(parts, lambda k: k != "")


def clean_keywords(raw: Column) -> Column:
    """Lower-cased keywords without repeats, in their order, joined by ', '."""
    return F.array_join(F.array_distinct(F.transform(split_keywords(raw), lambda k: F.lower(k))), ", ")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def folder_name(name: Column, inbox: str = "Eingang") -> tuple[Column, Column]:
    """(clean name, error): error is null if the name can be used."""
    clean = collapse(F.coalesce(name, F.lit("")))
    bad = clean.contains("/") | clean.contains("\\") | clean.isin(".", "..") | (F.lower(clean) == inbox.lower())
    error = F.when(clean == "", "Ordnername fehlt").when(bad, "Ungültiger Ordnername")
    return F.when(error.isNull(), F.substring(clean, 1, 80)), error


def tag_name(name: Column) -> Column:
    return F.substring(_strip(F.regexp_replace(name, r"\s+", " "), " ,;#"), 1, 60)


def suggest_folder_keywords(name: Column) -> Column:
    """Keywords for a new folder: from the dictionary, none for generic names, else the name."""
    key = F.trim(norm(name))
    table = _constant_map(FOLDER_KEYWORDS)
    own = F.when(key.isin(TOO_GENERIC) | (F.length(key) < 3), F.lit("")).otherwise(F.lower(name))
    return F.coalesce(F.try_element_at(table, key), own)


def clean_text(text: Column) -> Column:
    """Unix newlines, no NUL, single blanks, none around newlines, at most one empty line."""
    out = F.replace(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit("\x00"), F.lit(""))
    out = F.regexp_replace(out, r"[ \t\f\x0B]+", " ")
    out = F.regexp_replace(out, r" *\n *", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


# Entities that are frequent enough for the native path; &amp; comes last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&euro;", "€"),
            ("&auml;", "ä"), ("&ouml;", "ö"), ("&uuml;", "ü"), ("&Auml;", "Ä"), ("&Ouml;", "Ö"), ("&Uuml;", "Ü"), ("&szlig;", "ß"), ("&amp;", "&")]


# Fixed values below: the patterns for markup that goes with its content, for line ends and for tags.
def strip_html(source: Column) -> Column:
    """Markup dropped: scripts, styles and head with their content, block ends as newlines, other tags as blanks."""
    out = F.regexp_replace(source, r"(?is)<(script|style|head)\b.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|li|tr|h\d)>", "\n")
    return F.regexp_replace(out, r"(?s)<[^>]+>", " ")


def html_to_text(source: Column) -> Column:
    """Text of HTML. Entities other than the frequent ones are resolved in Arrow batches, for the texts that have any."""
    plain = strip_html(source)
    others = F.regexp_replace(plain, "|".join(e for e, _ in ENTITIES), "").rlike("&[#A-Za-z]")
    out = plain
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.coalesce(unescape(F.when(others, plain)), out)


def unescape(text: Column) -> Column:
    """All HTML entities as their characters; Arrow batches, nulls cost nothing."""

    @F.pandas_udf(StringType())
    def chars(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    return chars(text)


def prefix_terms(query: str) -> list[str]:
    """Words of a search query, as the index compares them; each is a prefix to be met."""
    out, word = [], ""
    for c in query + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    plain = ["".join(x for x in unicodedata.normalize("NFKD", w.lower()) if not unicodedata.combining(x)) for w in out]
    return [w for w in plain if w]


# --------------------------------------------------------------------------- export


def keyword_regex(keywords: Column) -> Column:
    """A pattern that finds each keyword as a part of a word, umlauts in either spelling."""

    def one(word: Column) -> Column:
        out = F.regexp_replace(F.lower(F.trim(word)), r"([.^$*+?{}\[\]\\|()#&~])", r"\\$1")
        for umlaut, both in (("ä", "(?:ä|ae)"), ("ö", "(?:ö|oe)"), ("ü", "(?:ü|ue)"), ("ß", "(?:ß|ss)")):
            out = F.replace(out, F.lit(umlaut), F.lit(both))
        return F.replace(F.replace(out, F.lit("-"), F.lit(r"[-\s]?")), F.lit(" "), F.lit(r"\s+"))

    parts = F.filter(F.transform(keywords, one), lambda w: w != "")
    return F.when(F.size(parts) > 0, F.concat(F.lit("(?:"), F.array_join(parts, "|"), F.lit(")"))).otherwise(F.lit(""))


def storage_template(path: Column, double_braces: bool = True) -> Column:
    """A / B as a storage path with the place holders of the archive's version."""
    base = F.array_join(F.transform(F.split(path, " / "), lambda p: F.replace(F.trim(p), F.lit("/"), F.lit("-"))), "/")
    if double_braces:
        return F.concat(base, F.lit("/{{ created_year }}-{{ created_month }}-{{ created_day }}_{{ title }}"))
    return F.concat(base, F.lit("/{created_year}-{created_month}-{created_day}_{title}"))


def german_number(value: Column) -> Column:
    return F.translate(F.format_number(value, 2), ",.", ".,")


def export_note(notes: Column, amount: Column, iban: Column, number: Column, original_name: Column, origin: str = "dem Dokumentenarchiv") -> Column:
    """The note that goes with an exported document, a line per thing that is known; origin: where it came from, in the dative."""
    lines = (
        F.nullif(notes, F.lit("")),
        F.concat(F.lit("Betrag: "), german_number(amount), F.lit(" €")),
        F.concat(F.lit("IBAN: "), F.nullif(iban, F.lit(""))),
        F.concat(F.lit(f"Übernommen aus {origin} (Nr. "), number.cast("string"), F.lit(", "), original_name, F.lit(")")),
    )
    return F.concat_ws("\n", *lines)
