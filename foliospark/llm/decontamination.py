"""Benchmark decontamination with a distributed positional inverted index.

Index: documents are cut into shards, runs of whole documents of about SHARD_BYTES of text. One row of the index
holds one shard: its words (sorted by id of first use), how often each occurs, and their postings, the
word positions in the shard, list after list. The index knows nothing of any benchmark; it is stored as
a table in the shared folder and can be asked again. Documents are never shuffled.

Asking: phrases come in blocks of about BLOCK_BYTES of text, one after another. The shards' word lists (without postings) say which
words of the block each shard holds, and how often; a phrase goes to the shards that hold its rarest word, and nowhere if a word
is in no shard; postings are read only where a phrase goes. In a shard a phrase's lists are taken rarest first; positions less the word's offset in the phrase are start positions, and
each further list, offset-adjusted likewise, keeps the starts it shares (exact), or the starts for which
it has a position within ``slop`` words (proximity). Phrases with a word that the shard lacks end at
once. What is left are occurrences; those across a border of two documents can't arise, as a position
that belongs to no word stands between them.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.

Defined cases: null and empty texts have no words; an item without words has no window; a null
item_id's windows hit but count as no item; repeated items count once; repeated documents are judged
each; a text longer than SHARD_BYTES is a shard of its own, indexed whole; empty tables give no hits or no rows; further columns play no part, whatever their names, and drop_leaks gives them back as they are.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import TEXT_ROWS, WORD_BYTES, batch_rows, local_table, small, stored, thrifty

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20

INDEX_SCHEMA = (
    "doc_id array<bigint>, n_words array<bigint>, words binary, word_rows array<int>, postings binary"
)
HIT_SCHEMA = "shard bigint, row int, starts array<int>, ends array<int>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def _shards(batches, limit: int):
    """(doc ids, texts) of about limit bytes each, in input order."""
    ids: list = []
    texts: list = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            ids.append(i)
            texts.append(t or b"")
            size += len(texts[-1]) + 16
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _index_shard(ids: list, texts: list[bytes]) -> dict:
    number = defaultdict(count().__next__)
    parts, lengths = [], []
    for t in texts:
        w = words_of(t)
        lengths.append(len(w))
        parts.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
    n_words = np.array(lengths, np.int64)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
    # a free position after each document keeps phrases from crossing
    at = np.arange(len(flat), dtype=np.int32) + np.repeat(np.arange(len(texts), dtype=np.int32), n_words)
    order = np.argsort(flat, kind="stable")
    rows = np.bincount(flat, minlength=len(number)).astype(np.int32)
    lists = at[order]
    if len(lists):  # gaps compress better than positions
        gaps = np.diff(lists, prepend=np.int32(0)).astype(np.int32)
        lists = gaps
    return {
        "doc_id": ids,
        "n_words": n_words,
        "words": b" ".join(number),
        "word_rows": rows,
        "postings": lists.tobytes(),
    }


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The stored positional index of docs (doc_id, text)."""
    arrow = pa.schema(
        [("doc_id", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("words", pa.binary()), ("word_rows", pa.list_(pa.int32())), ("postings", pa.binary())]
    )

    def index(batches):
        for ids, texts in _shards(batches, shard_bytes):
            row = _index_shard(ids, texts)
            yield pa.RecordBatch.from_pylist([row], schema=arrow)

    shards = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(thrifty(index), INDEX_SCHEMA)
    with batch_rows(docs.sparkSession, TEXT_ROWS):
        return stored(shards.withColumn("shard", F.monotonically_increasing_id()), "postings")


def windows_of(items: list[tuple], window: int) -> dict[tuple, set]:
    """Phrase (a tuple of words) to the ids of the items that have it."""
    out: dict[tuple, set] = {}
    for item, text in items:
        w = words_of((text or "").encode())
        for k in range(max(1, len(w) - window + 1) if w else 0):
            out.setdefault(tuple(w[k : k + window]), set()).add(item)
    return out


def _near(starts: np.ndarray, found: np.ndarray, slop: int) -> np.ndarray:
    """Of starts, those with a member of the sorted array found at most slop away."""
    k = np.searchsorted(found, starts - slop)
    ok = k < len(found)
    ok[ok] = found[k[ok]] <= starts[ok] + slop
    return starts[ok]


def search_shard(row: dict, phrases: list[tuple], slop: int = 0) -> list[tuple[int, np.ndarray]]:
    """(phrase number, start positions in the shard) for the phrases that occur."""
    asked = {w for p in phrases for w in p}
    number = {w: k for k, w in enumerate(row["words"].split(b" ")) if w in asked} if row["words"] else {}
    rows = np.asarray(row["word_rows"], np.int64)
    ends = np.cumsum(rows)
    lists = np.cumsum(np.frombuffer(row["postings"], np.int32), dtype=np.int32)

    def postings(word: int) -> np.ndarray:
        return lists[ends[word] - rows[word] : ends[word]]

    found = []
    for k, phrase in enumerate(phrases):
        try:
            ids = [number[w] for w in phrase]
        except KeyError:
            continue
        order = sorted(range(len(ids)), key=lambda o: rows[ids[o]])
        starts = postings(ids[order[0]]) - order[0]
        for o in order[1:]:
            other = postings(ids[o]) - o
            starts = _near(starts, other, slop) if slop else starts[_holds(other, starts)]
            if not len(starts):
                break
        if len(starts):
            found.append((k, starts))
    return found


def _holds(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    k = np.searchsorted(sorted_values, wanted)
    k[k == len(sorted_values)] = 0
    return sorted_values[k] == wanted


def _hits_of(row: dict, phrases: list[tuple], items: list[list[str]], slop: int):
    """Per document of the shard: hit word spans (start, end) and item ids."""
    n_words = np.asarray(row["n_words"], np.int64)
    first = np.cumsum(n_words + 1) - (n_words + 1)
    spans = defaultdict(list)
    named = defaultdict(set)
    for k, starts in search_shard(row, phrases, slop):
        docs = np.searchsorted(first, np.maximum(starts, 0), side="right") - 1
        for d, s in zip(docs.tolist(), (starts - first[docs]).tolist()):
            spans[d].append((max(s, 0), min(s + len(phrases[k]), int(n_words[d]))))
            named[d].update(items[k])
    for d, got in spans.items():
        got.sort()
        merged = [list(got[0])]
        for s, e in got[1:]:
            if s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        spans[d] = merged
    return spans, named


def routes(index: DataFrame, phrases: list[tuple]) -> DataFrame:
    """shard, asked: the numbers of the phrases that go to each shard, those with a phrase only."""
    spark = index.sparkSession
    number: dict[bytes, int] = {}
    for p in phrases:
        for w in p:
            number.setdefault(w, len(number))
    sent = spark.sparkContext.broadcast(number)

    def hold(batches):
        lookup = sent.value
        for batch in batches:
            for shard, words, rows in zip(*(c.to_pylist() for c in batch.columns)):
                held = [(lookup[w], n) for w, n in zip(words.split(b" "), rows) if w in lookup] if words else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(held), pa.int64()), pa.array([t for t, _ in held], pa.int32()), pa.array([n for _, n in held], pa.int64())], names=["shard", "term", "n"]
                )

    holding = stored(index.select("shard", "words", "word_rows").mapInArrow(thrifty(hold), "shard bigint, term int, n bigint"), "terms")
    total = dict(holding.groupBy("term").agg(F.sum("n")).collect())  # at most the block's words
    rarest = []
    for k, p in enumerate(phrases):
        ids = [number[w] for w in p]
        if all(i in total for i in ids):
            rarest.append((min(ids, key=lambda i: (total[i], i)), k))
    asked = local_table(spark, rarest, "term int, phrase int")  # at most the block's phrases
    return holding.join(F.broadcast(asked), "term").groupBy("shard").agg(F.collect_list("phrase").alias("asked"))


def matches(index: DataFrame, phrases: dict[tuple, set], slop: int = 0) -> DataFrame:
    """shard, row, starts, ends, items of the documents with a phrase: merged word spans covered by one, and the items they are of."""
    spark = index.sparkSession
    keys = list(phrases)
    asked = small(stored(routes(index, keys), "routes"))
    sent = spark.sparkContext.broadcast((keys, [sorted(str(i) for i in phrases[k] if i is not None) for k in keys], slop))

    def ask(batches):
        keys, items, slop = sent.value
        for batch in batches:
            for at in range(batch.num_rows):  # a row holds a shard
                row = batch.slice(at, 1).to_pylist()[0]
                mine = sorted(row["asked"])
                spans, named = _hits_of(row, [keys[k] for k in mine], [items[k] for k in mine], slop)
                hit = sorted(spans)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * len(hit), pa.int64()),
                        pa.array(hit, pa.int32()),
                        pa.array([[s for s, _ in spans[d]] for d in hit], pa.list_(pa.int32())),
                        pa.array([[e for _, e in spans[d]] for d in hit], pa.list_(pa.int32())),
                        pa.array([sorted(named[d]) for d in hit], pa.list_(pa.string())),
                    ],
                    names=["shard", "row", "starts", "ends", "items"],
                )

    return index.join(asked, "shard").mapInArrow(thrifty(ask), HIT_SCHEMA)


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The benchmark in blocks: lists of (item_id, text), each of about block_bytes, one in memory at a time."""
    text = F.coalesce("text", F.lit(""))
    whole = benchmark.agg(F.coalesce(F.sum(F.octet_length(text) + 16), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-whole // block_bytes))
    rows = benchmark.select("item_id", "text").distinct()
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """One row per document: doc_id, n_words, spans (array of start, end in words), items (array of item ids)."""
    index = build_index(docs, shard_bytes)
    pair = F.arrays_zip("starts", "ends")
    union = None
    for block in _blocks(benchmark, block_bytes):  # what a block found is written before the next one is read
        with batch_rows(docs.sparkSession, 1):  # a row holds a shard
            found = stored(matches(index, windows_of(block, window), slop).select("shard", "row", pair.alias("spans"), "items"), "hits")
        union = found if union is None else union.unionByName(found)
    rows = union.groupBy("shard", "row").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )  # a row per block each
    empty = F.array().cast("array<struct<starts:int,ends:int>>")
    merged = F.aggregate(
        "spans",
        empty,
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["ends"] >= s["starts"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.try_element_at(acc, F.lit(-1))["starts"].alias("starts"), F.greatest(F.try_element_at(acc, F.lit(-1))["ends"], s["ends"]).alias("ends"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    every = index.select("shard", F.posexplode(F.arrays_zip("doc_id", "n_words")).alias("row", "d")).select("shard", "row", "d.doc_id", "d.n_words")
    found = every.join(rows.withColumn("spans", merged), ["shard", "row"], "left")
    return found.select("shard", "row", "doc_id", "n_words", F.coalesce("spans", empty).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the rows that contain a phrase of the benchmark; all columns stay as they are."""
    mark = F.xxhash64("doc_id", "text")  # tells apart texts that share a doc_id
    leaks = find_leaks(docs.select(mark.alias("doc_id"), "text"), benchmark, window).where(F.size("spans") > 0)
    gone = stored(leaks.select(F.col("doc_id").alias("_fs_mark")).distinct(), "leaks")
    return docs.withColumn("_fs_mark", mark).join(small(gone), "_fs_mark", "left_anti").select(*docs.columns)


def digest(leaks: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["ends"] - s["starts"])
    return leaks.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, CAST(least(len(w), 10) AS BIGINT) AS n, array_to_string(w[k : k + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
grams AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM dw, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, g.k, g.n, item_id FROM grams g JOIN wins USING (win, n)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
