"""Substring dedup over sliding sentence spans.

Every run of consecutive sentences is hashed over its words (96 bits): from each sentence on, the shortest run of at least RUN
sentences and MIN_WORDS words, and the last such run drawn out to the end of the text; a text that has no such run is one run
itself. The hashes of all documents meet in one grouping; sentences covered by a run that is not the first of its kind are
removed. First means smallest (doc_id, position). Runs that occur once, nearly all, leave after a count per hash; the texts
are shuffled once, at the end, with the short lists of what goes.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A sentence ends after a word if what stands before the next word
has a newline, or one of ``.!?`` and, anywhere behind it, a blank: decoration between them doesn't matter. Sentences of
more than LONG words are cut into pieces that count as sentences: every WINDOW words in a row name the one of them with the smallest MD5 (its first
48 bits; the last of equal ones), and a piece ends there. So cuts depend on nearby words alone, a passage is cut alike wherever it stands, and
no piece has more than WINDOW words. What stands behind a word belongs to its sentence; what stands before the first word belongs to none and stays.
Runs are compared by their words, so they may differ in case and punctuation.

What it finds: a repeated passage of more than 2 * LONG + MIN_WORDS = 50 words. What stands around it can change how up to LONG words at either end are
cut; between them whole sentences or pieces with MIN_WORDS words are left, the same in every copy, and they make a run. Of shorter passages some are missed.

Defined cases: null texts stay null and have no sentences; texts without a word lose nothing; a null doc_id is smaller than any
number; documents are told apart by (doc_id, hash of text); of fully repeated rows one is the first, the others lose all
their sentences; very long texts are held whole by the task that cuts them (about 60 bytes of memory per byte) and have as many
runs as sentences; an empty table gives an empty result; further columns stay as they are, but for n_sentences and n_removed, which
the result's own replace.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import WORD_BYTES, drop_tables, recording, span_hashes, stored, thrifty

RUN = 2
MIN_WORDS = 24
LONG = 13
WINDOW = 8
BATCH_BYTES = 1 << 20

#: What a byte is: part of a word, an end mark, a blank, a newline, or anything else (0).
_WORD, _MARK, _BLANK, _NEWLINE = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[[b for b in range(256) if WORD_BYTES[b] != 0x20]] = _WORD
_KIND[list(b".!?")] = _MARK
_KIND[list(b" \t\r")] = _BLANK
_KIND[list(b"\n")] = _NEWLINE


class Sentences(NamedTuple):
    """The sentences of several texts, one after another."""

    begin: np.ndarray  # bytes from the start of the own text
    end: np.ndarray
    first: np.ndarray  # words, numbered over all texts
    stop: np.ndarray
    many: np.ndarray  # sentences per text
    keys: tuple[np.ndarray, np.ndarray]  # two 64-bit hashes per word


def _cuts(value: np.ndarray, first: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
    """The words that some window within a sentence names: the smallest value, the last of equal ones."""
    places = size - window + 1
    at = np.repeat(first - np.r_[0, np.cumsum(places)[:-1]], places) + np.arange(int(places.sum()))
    best, named = value[at], at.copy()
    for j in range(1, window):
        other = value[at + j]
        better = other <= best
        best[better] = other[better]
        named[better] = at[better] + j
    return named


def sentences(texts: list[bytes], long: int = LONG, window: int = WINDOW) -> Sentences:
    import hashlib
    from collections import defaultdict
    from itertools import count

    joined = b"\n".join(texts) + b"\n"
    kind = _KIND[np.frombuffer(joined, np.uint8)]
    opens = np.diff((kind == _WORD).view(np.int8), prepend=np.int8(0)) == 1
    starts = np.flatnonzero(opens)
    n = len(starts)
    lengths = np.array([len(t) for t in texts], np.int64)
    text_at = np.cumsum(lengths + 1) - lengths - 1
    none = np.empty(0, np.int64)
    if not n:
        return Sentences(none, none, none, none, np.zeros(len(texts), np.int64), (none.astype(np.uint64),) * 2)
    word_at = np.cumsum(opens, dtype=np.int32) - 1  # the last word begun, per byte
    owner = np.searchsorted(text_at, starts, "right") - 1
    border = np.r_[owner[1:] != owner[:-1], True]
    lines = word_at[kind == _NEWLINE]
    border[lines[lines >= 0]] = True
    marks, blanks = np.flatnonzero(kind == _MARK), np.flatnonzero(kind == _BLANK)
    mark, blank = np.full(n + 1, len(joined)), np.full(n + 1, -1)  # the place n stands for before the first word
    mark[word_at[marks][::-1]] = marks[::-1]  # the first one wins
    blank[word_at[blanks]] = blanks  # the last one wins
    border |= blank[:n] > mark[:n]

    number = defaultdict(count().__next__)
    words = joined.translate(WORD_BYTES).split()
    ids = np.fromiter(map(number.__getitem__, words), np.int32, n)
    del words
    digests = np.frombuffer(b"".join([hashlib.md5(w).digest() for w in number]), ">u8").astype(np.uint64).reshape(-1, 2)
    keys = digests[ids, 0], digests[ids, 1]
    value = (keys[0] >> np.uint64(16)).view(np.int64)

    stop = np.flatnonzero(border) + 1
    first = np.r_[0, stop[:-1]]
    large = stop - first > long
    if large.any():
        border[_cuts(value, first[large], (stop - first)[large], window)] = True
        stop = np.flatnonzero(border) + 1
        first = np.r_[0, stop[:-1]]
    whose = owner[first]
    begin = starts[first] - text_at[whose]
    last = np.r_[whose[1:] != whose[:-1], True]
    end = np.where(last, lengths[whose], np.r_[begin[1:], 0])
    return Sentences(begin, end, first, stop, np.bincount(whose, minlength=len(texts)), keys)


def runs(found: Sentences, run: int = RUN, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all runs, text by text: first sentence, sentence behind the last (numbered within the text), two hashes; runs per text."""
    many = found.many
    behind = np.cumsum(many)
    k = np.arange(len(found.first))
    text = np.repeat(np.arange(len(many)), many)
    j = np.maximum(np.searchsorted(found.stop, found.first + min_words), k + run - 1)
    ok = j < behind[text]
    full = np.bincount(text[ok], minlength=len(many))  # the sentences that begin a run come first
    has = np.flatnonzero(many)
    zero = behind - many
    from_ = zero + np.maximum(full - 1, 0)
    more = has[(full[has] == 0) | (j[np.minimum(from_[has], len(k) - 1)] < behind[has] - 1)]
    begin, end = np.r_[k[ok], from_[more]], np.r_[j[ok], behind[more] - 1]
    order = np.argsort(np.r_[text[ok], more], kind="stable")
    begin, end = begin[order], end[order]
    owner = np.r_[text[ok], more][order]
    h, g = (span_hashes(x, found.first[begin], found.stop[end]) for x in found.keys)
    return begin - zero[owner], end + 1 - zero[owner], h, g, np.bincount(owner, minlength=len(many))


def _slices(texts: list[bytes], limit: int = BATCH_BYTES):
    """Ranges of texts of about limit bytes together."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def repeated_runs(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, long: int = LONG) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash, spans of the documents with runs that occurred before, in order of (doc_id, text_hash, span); and all documents:
    doc_id, text_hash, n (sentences), rows. A span is its first sentence * 2**32 plus the one behind its last.
    """
    schema = "doc_id bigint, text_hash bigint, n int, span array<bigint>, h array<bigint>, g array<int>"

    def cut(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            for s, e in _slices(texts):
                found = sentences(texts[s:e], long)
                at, to, h, g, many = runs(found, run, min_words)
                offsets = pa.array(np.r_[0, np.cumsum(many)].astype(np.int32))
                flat = ((at << 32) | to, h.view(np.int64), (g >> np.uint64(32)).astype(np.uint32).view(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in flat]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s, e - s), batch.column(1).slice(s, e - s), pa.array(found.many.astype(np.int32)), *lists],
                    names=["doc_id", "text_hash", "n", "span", "h", "g"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").where("text IS NOT NULL")
    passing: list[str] = []
    with recording(passing):
        table = stored(rows.mapInArrow(thrifty(cut), schema).withColumn("no", F.monotonically_increasing_id()), "runs")
        flat = table.select("no", F.inline(F.arrays_zip("span", "h", "g")))
        # half the hash is enough to drop most runs; stored, so that the join deals both sides anew and Spark can split hot runs
        often = stored(flat.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "often")
    shared = flat.join(often.hint("shuffle_hash"), "h").join(table.select("no", "doc_id", "text_hash"), "no").drop("no")
    shared = stored(shared, "shared")
    every = stored(table.groupBy("doc_id", "text_hash").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("rows")), "every")
    drop_tables(docs.sparkSession, passing)  # most runs occur once
    first = stored(shared.groupBy("h", "g").agg(F.min(F.struct("doc_id", "text_hash", "span")).alias("first")), "first")
    same = [F.col(f"first.{c}").eqNullSafe(F.col(c)) for c in ("doc_id", "text_hash", "span")]
    later = shared.join(first, ["h", "g"]).where(~(same[0] & same[1] & same[2]))
    gone = later.groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("spans"))
    return gone, every


def _numbered(plain: DataFrame, doc: str, twice: DataFrame) -> DataFrame:
    """plain with _fs_again: true for all but one of fully repeated rows."""
    if twice.isEmpty():
        return plain.withColumn("_fs_again", F.lit(False))
    keys = twice.select(F.col("doc_id").alias("_fs_d"), F.col("text_hash").alias("_fs_h"))
    on = (plain["_fs_key"] == keys["_fs_h"]) & plain[doc].eqNullSafe(keys["_fs_d"])
    once = plain.join(keys, on, "left_anti").withColumn("_fs_again", F.lit(False))
    # numbers of rows, so that no group of copies has to be in one task
    several = stored(plain.join(keys, on, "left_semi").withColumn("_fs_no", F.monotonically_increasing_id()), "several")
    kept = several.groupBy(doc, "_fs_key").agg(F.min("_fs_no").alias("_fs_no")).select("_fs_no", F.lit(True).alias("_fs_kept"))
    marked = several.join(kept, "_fs_no", "left").withColumn("_fs_again", F.col("_fs_kept").isNull())
    return once.unionByName(marked.select(once.columns))


def drop_repeats(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, long: int = LONG) -> DataFrame:
    """docs with text cut, and the columns n_sentences and n_removed."""
    gone, every = repeated_runs(docs, run, min_words, long)
    names = [f"_fs_{i}" for i in range(len(docs.columns))]
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], F.xxhash64("text").alias("_fs_key"))
    doc, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    every = every.select(F.col("doc_id").alias("_fs_doc"), F.col("text_hash").alias("_fs_hash"), F.col("n").alias("_fs_n"), "rows")
    found = gone.select(F.col("doc_id").alias("_fs_d"), F.col("text_hash").alias("_fs_h"), "spans")
    fate = every.join(found, (every["_fs_hash"] == found["_fs_h"]) & every["_fs_doc"].eqNullSafe(found["_fs_d"]), "left")
    fate = stored(fate.select("_fs_doc", "_fs_hash", "_fs_n", "rows", "spans"), "fate")
    plain = _numbered(plain, doc, fate.where("rows > 1").select(F.col("_fs_doc").alias("doc_id"), F.col("_fs_hash").alias("text_hash")))
    fate = fate.drop("rows")
    joined = plain.join(fate.hint("shuffle_hash"), (plain["_fs_key"] == fate["_fs_hash"]) & plain[doc].eqNullSafe(fate["_fs_doc"]), "left")
    at = names.index(text)

    def cut(batches):
        for batch in batches:
            many, spans, again = (batch.column(len(names) + k) for k in range(3))
            many = many.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            again = again.to_numpy(zero_copy_only=False).astype(bool)
            lost = np.zeros(len(many), np.int64)
            out = batch.column(at).cast(pa.binary())
            touched = np.flatnonzero((again | spans.is_valid().to_numpy(zero_copy_only=False)) & (many > 0))
            if len(touched):
                texts = out.to_pylist()
                for s, e in _slices([texts[k] for k in touched]):
                    mine = touched[s:e]
                    part = sentences([texts[k] for k in mine], long)
                    zero = np.cumsum(part.many) - part.many
                    flat = spans.take(pa.array(mine)).fill_null([])
                    owner = np.repeat(zero, pa.compute.list_value_length(flat).to_numpy(zero_copy_only=False))
                    span = flat.flatten().to_numpy(zero_copy_only=False)
                    steps = np.zeros(len(part.begin) + 1, np.int64)
                    np.add.at(steps, owner + (span >> 32), 1)
                    np.add.at(steps, owner + (span & 0xFFFFFFFF), -1)
                    gone = (np.cumsum(steps)[:-1] > 0) | np.repeat(again[mine], part.many)
                    for k, z, m in zip(mine.tolist(), zero.tolist(), part.many.tolist()):
                        t, keep = texts[k], np.flatnonzero(~gone[z : z + m]) + z
                        lost[k] = m - len(keep)
                        texts[k] = b"".join([t[: part.begin[z]], *(t[a:b] for a, b in zip(part.begin[keep].tolist(), part.end[keep].tolist()))])
                out = pa.array(texts, pa.binary())
            cols = list(batch.columns[: len(names)])
            cols[at] = out.cast(pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(many), pa.array(lost)], names=[*names, "n_sentences", "n_removed"])

    kinds = [f"{n} {plain.schema[n].dataType.simpleString()}" for n in names]
    out = joined.select(*names, "_fs_n", "spans", "_fs_again").mapInArrow(thrifty(cut), ", ".join([*kinds, "n_sentences bigint", "n_removed bigint"]))
    own = [(n, c) for n, c in zip(names, docs.columns) if c not in ("n_sentences", "n_removed")]
    return out.select(*[F.col(n).alias(c) for n, c in own], "n_sentences", "n_removed")


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_repeats(docs)
    return out.select("doc_id", "n_sentences", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), "text")


ORACLE = r"""
WITH raw AS (
  SELECT doc_id, text, regexp_extract(text, '^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*') AS lead,
         regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*') AS toks FROM documents),
tok AS (SELECT doc_id, unnest(toks) AS tok, unnest(range(len(toks))) AS i FROM raw),
word AS (
  SELECT doc_id, i, tok, translate(regexp_extract(tok, '^[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w,
         regexp_matches(tok, '(?s)\n|[.!?].*[ \t\r]') AS closes FROM tok),
sent AS (SELECT *, coalesce(sum(closes::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM word),
sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS size, row_number() OVER (PARTITION BY doc_id, s ORDER BY i) AS k FROM sent),
named AS (
  SELECT doc_id, size, k, CAST(min(CAST('0x' || substr(md5(w), 1, 12) AS HUGEINT) * 1073741824 - i) OVER (PARTITION BY doc_id, s ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS HUGEINT) AS best
  FROM sized WHERE size > 13),
cut AS (SELECT DISTINCT doc_id, CAST((1073741824 - best % 1073741824) % 1073741824 AS BIGINT) AS i FROM named WHERE k <= size - 7),
ends AS (SELECT z.*, closes OR cut.i IS NOT NULL AS ends FROM sized z LEFT JOIN cut ON cut.doc_id = z.doc_id AND cut.i = z.i),
parts AS (SELECT *, CAST(coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS u FROM ends),
unit AS (SELECT doc_id, u, string_agg(tok, '' ORDER BY i) AS piece, string_agg(w, ' ' ORDER BY i) AS said, min(i) AS first, max(i) + 1 AS stop FROM parts GROUP BY doc_id, u),
need AS (SELECT *, greatest(first + 24, lead(stop) OVER (PARTITION BY doc_id ORDER BY u)) AS need, count(*) OVER (PARTITION BY doc_id) AS n FROM unit),
full_run AS (SELECT a.doc_id, a.u, b.u AS last, a.n FROM (SELECT * FROM need WHERE u < n - 1) a ASOF JOIN unit b ON a.doc_id = b.doc_id AND a.need <= b.stop),
tail AS (
  SELECT doc_id, max(u) AS u, any_value(n) - 1 AS last FROM full_run GROUP BY doc_id HAVING max(last) < any_value(n) - 1
  UNION ALL SELECT doc_id, 0, max(u) FROM unit WHERE doc_id NOT IN (SELECT doc_id FROM full_run) GROUP BY doc_id),
run AS (SELECT doc_id, u, last FROM full_run UNION ALL SELECT doc_id, u, last FROM tail),
keyed AS (
  SELECT r.doc_id, r.u, last, string_agg(said, ' ' ORDER BY unit.u) AS words FROM (SELECT *, unnest(range(u, last + 1)) AS at FROM run) r
  JOIN unit ON unit.doc_id = r.doc_id AND unit.u = r.at GROUP BY r.doc_id, r.u, last),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY words ORDER BY doc_id, u, last) AS k FROM keyed) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(u, last + 1)) AS u FROM later),
j AS (SELECT unit.doc_id, unit.u, piece, gone.u IS NOT NULL AS drop_it FROM unit LEFT JOIN gone ON gone.doc_id = unit.doc_id AND gone.u = unit.u)
SELECT d.doc_id, count(j.u) AS n_sentences, count(j.u) FILTER (WHERE drop_it) AS n_removed,
       sha256(coalesce(any_value(d.lead), '') || coalesce(string_agg(piece, '' ORDER BY u) FILTER (WHERE NOT drop_it), '')) AS kept_sha256,
       CASE WHEN any_value(d.text) IS NOT NULL THEN any_value(d.lead) || coalesce(string_agg(piece, '' ORDER BY u) FILTER (WHERE NOT drop_it), '') END AS text
FROM raw d LEFT JOIN j ON d.doc_id = j.doc_id GROUP BY d.doc_id
"""
