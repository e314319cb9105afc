"""Substring dedup with suffix arrays that are built by external induced sorting.

Every byte covered by a string of LENGTH bytes that also starts anywhere else, in another document or in the same one, is
removed. All strings are judged on the input; matches never cross documents.

One suffix array over all suffixes of a corpus costs many times its size in disk and sorting. So the corpus is first cut down to where
a match can be. Each window of LENGTH bytes picks the smallest of the hashes of its SEED-byte substrings (the last, if
several are), its anchor: equal windows have their anchors at the same place. An anchor whose hash occurs once in the corpus
has no window with a match. The bytes of all windows that have the same anchor are its segment; equal segments around the
same anchor hash are counted, and one of them stands for all. Segments are dealt to shards by
anchor hash, so windows that match meet in one shard. Anchors with one kind of segment have matches in its copies alone; their segments go to the sort as well, those that follow one
another in a document joined, as no other segment has to meet them. There the suffixes of all segments are sorted (see induced_sort), and neighbours with
LENGTH bytes in common form runs. Two members of a run match if their anchor is at the same distance: then they are two
places of the corpus, and not one place that lies in two segments. What is found goes back to all documents that have the segment.

Memory: a shard has about SHARD_BYTES, and its text, order and owners are held in memory; the queues of the sorting go to disk
beyond their budget. An anchor hash whose kinds of segment have more than HOT_BYTES is not sorted but divided exactly: its windows are
dealt by (anchor, distance to the anchor, 128-bit hash of the window), so equal windows still meet, and no task gets all of an anchor.

Defined cases: null texts are empty; texts shorter than LENGTH lose nothing; repeated rows are documents of their own, so each loses what it
shares with the other; documents are told apart by (doc_id, hash of text); a null doc_id is allowed; empty tables give no rows;
further columns play no part, whatever their names; very long texts are hashed in pieces of PIECE windows, and held whole by the tasks that read them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import drop_tables, mix64, recording, stored, thrifty
from foliospark.llm.induced_sort import BUDGET, long_common, suffix_array

LENGTH = 200
SEED = 100
#: Text of a shard, which should fit a core's cache, and of a task's shards together.
SHARD_BYTES = 256 << 10
TASK_BYTES = 8 << 20
#: Segments of one anchor that are sorted together; more are dealt window by window.
HOT_BYTES = 1 << 20
#: Windows that are looked at together; longer texts are handled piece by piece.
PIECE = 1 << 18


def _powers(n: int) -> dict:
    p = 0x9E3779B97F4A7C15 | 1
    inverse = pow(p, -1, 1 << 64)
    return {
        "up": np.cumprod(np.r_[np.uint64(1), np.full(n, p, np.uint64)], dtype=np.uint64),
        "down": np.cumprod(np.r_[np.uint64(1), np.full(n, inverse, np.uint64)], dtype=np.uint64),
        "byte": mix64(np.arange(1, 257, dtype=np.uint64)),
    }


def _piece_anchors(raw: np.ndarray, low: int, high: int, length: int, seed: int, table: dict) -> tuple[np.ndarray, ...]:
    """Anchors whose first window starts in [low, high): position, hash, hash of the segment, bytes of it before and from the anchor on."""
    reach = length - seed
    # windows before and behind, so that no group of windows is cut
    begin, stop = max(0, low - reach - 1), min(len(raw) - length + 1, high + reach + 1)
    part = raw[begin : stop + length - 1]
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(table["byte"][part] * table["up"][: len(part)], dtype=np.uint64, out=sums[1:])

    def hashed(s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix64((sums[e] - sums[s]) * table["down"][s])

    many = stop - begin + reach  # seeds of these windows
    at = np.arange(many)
    h = hashed(at, at + seed)
    bits = np.uint64(20)
    back = np.arange(many, 0, -1).astype(np.uint64)  # of equal hashes the last one wins
    v = ((h >> bits) << bits) | back
    width, done = reach + 1, 1
    while done * 2 <= width:
        v = np.minimum(v[:-done], v[done:])
        done *= 2
    if done < width:
        v = np.minimum(v[: len(v) - (width - done)], v[width - done :])
    pick = many - (v & np.uint64((1 << 20) - 1)).astype(np.int64)
    # windows in a row with the same anchor; their bytes are the segment
    first = np.flatnonzero(np.r_[True, pick[1:] != pick[:-1]])
    last = np.append(first[1:], len(pick)) - 1
    mine = (first + begin >= low) & (first + begin < high)
    s, e = first[mine], last[mine] + length
    a = pick[s]
    context = mix64(hashed(s, e) ^ mix64((e - s).astype(np.uint64) * np.uint64(1024) + (a - s).astype(np.uint64)))
    return a + begin, h[a], context, a - s, e - a


def anchors(text: bytes, length: int = LENGTH, seed: int = SEED, piece: int = PIECE, table: dict | None = None):
    """Of the anchors of a text: positions, hashes, hashes of their segments, and the segments' bytes before and from the anchor on."""
    raw = np.frombuffer(text, np.uint8)
    n = len(raw) - length + 1
    if n < 1:
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    table = table or _powers(min(len(raw), piece + 5 * length))
    got = [_piece_anchors(raw, k, min(k + piece, n), length, seed, table) for k in range(0, n, piece)]
    at, h, context, lead, tail = (np.concatenate(x) for x in zip(*got))
    return at, h.view(np.int64), context.view(np.int64), lead, tail


def matched(segments: list[bytes], leads: np.ndarray, copies: np.ndarray, length: int = LENGTH, budget: int = BUDGET) -> list[tuple[list[int], list[int]]]:
    """Per segment the spans (starts, ends) covered by strings of length bytes that occur in two places.

    leads: bytes before the anchor in each segment; copies: places of the corpus that have the segment.
    """
    sizes = np.array([len(s) for s in segments], np.int64)
    joined = b"\0".join(segments) + b"\0"
    raw = np.frombuffer(joined, np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    used = np.zeros(256, bool)
    used[raw] = True
    text = np.cumsum(used).astype(np.int16)[raw]  # symbols from 1 in the order of their bytes
    text[begin + sizes] = 0
    order = suffix_array(text, int(used.sum()) + 1, budget)
    del text
    owner = np.repeat(np.arange(len(segments), dtype=np.int32), sizes + 1)
    inside = (np.arange(len(raw)) - begin[owner]).astype(np.int32)
    # suffixes with length bytes left whose window holds the anchor
    fits = (inside + length <= sizes[owner]) & (inside <= leads[owner])
    order = order[fits[order]]
    if not len(order):
        return [([], []) for _ in segments]
    run = np.r_[0, np.cumsum(~long_common(raw, order, length))]
    distance = leads[owner[order]] - inside[order]
    key = run * (int(leads.max()) + 1) + distance
    kinds, which, many = np.unique(key, return_inverse=True, return_counts=True)
    twice = (many[which] > 1) | (copies[owner[order]] > 1)
    hit = np.sort(order[twice])
    out: list[tuple[list[int], list[int]]] = [([], []) for _ in segments]
    if len(hit):
        seg, p = owner[hit], inside[hit].astype(np.int64)
        new = np.r_[True, (seg[1:] != seg[:-1]) | (p[1:] > p[:-1] + length)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(hit)) - 1
        for s, a, b in zip(seg[first].tolist(), p[first].tolist(), (p[last] + length).tolist()):
            out[s][0].append(a)
            out[s][1].append(b)
    return out


def hot_matches(parts: DataFrame, length: int) -> DataFrame:
    """anchor, segment, starts, ends of the repeated windows, by their hashes instead of a sort; starts and ends count from the anchor."""

    def windows(batches):
        import xxhash

        for batch in batches:
            anchor, segment, copies, lead, text = (batch.column(k).to_pylist() for k in range(5))
            n = [max(0, min(l, len(t) - length) + 1) for l, t in zip(lead, text)]
            which = np.repeat(np.arange(len(n)), n)
            distance = [l - i for l, k in zip(lead, n) for i in range(k)]
            digest = [xxhash.xxh3_128_digest(t[i : i + length]) for t, k in zip(text, n) for i in range(k)]
            cols = [pa.array(np.array(c, np.int64)[which]) for c in (anchor, segment, copies)]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(distance, pa.int32()), pa.array(digest, pa.binary())], names=["anchor", "segment", "copies", "distance", "digest"]
            )

    table = parts.select("anchor", "segment", "copies", "lead", "bytes").mapInArrow(thrifty(windows), "anchor bigint, segment bigint, copies bigint, distance int, digest binary")
    table, keys = stored(table, "windows"), ["anchor", "distance", "digest"]
    # stored, so that Spark can split a passage that many segments have
    twice = stored(table.groupBy(*keys).agg(F.sum("copies").alias("n")).where("n > 1").select(*keys), "twice")
    # all windows of a segment hold its anchor, so they overlap and make one span
    return (
        table.join(twice.hint("shuffle_hash"), keys)
        .groupBy("anchor", "segment")
        .agg(F.array((-F.max("distance")).cast("int")).alias("starts"), F.array((F.lit(length) - F.min("distance")).cast("int")).alias("ends"))
    )


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, seed: int = SEED, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES, budget: int = BUDGET
) -> DataFrame:
    """doc_id, text_hash, spans (array of start, end in bytes, unmerged) of the documents that have any."""

    def find(batches):
        table = _powers(PIECE + 5 * length)
        for batch in batches:
            got = [anchors(t, length, seed, PIECE, table) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            cut = np.r_[0, np.cumsum([len(g[0]) for g in got])].astype(np.int32)
            flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*got)]
            kinds = (np.int32, np.int64, np.int64, np.int16, np.int16)
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(v.astype(kind))) for v, kind in zip(flat, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "text_hash", "at", "anchor", "segment", "lead", "tail"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").where(F.octet_length("text") >= length)
    table = rows.mapInArrow(find, "doc_id bigint, text_hash bigint, at array<int>, anchor array<bigint>, segment array<bigint>, lead array<smallint>, tail array<smallint>")
    passing: list[str] = []
    with recording(passing):
        flat = stored(table, "anchors").select("doc_id", "text_hash", F.inline(F.arrays_zip("at", "anchor", "segment", "lead", "tail")))
        often = stored(flat.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "often")
    shared = stored(flat.join(often.hint("shuffle_hash"), "anchor"), "shared")
    drop_tables(docs.sparkSession, passing)  # most anchors are not shared
    kinds = shared.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_hash", "at", "lead", "tail")).alias("one"))
    kinds = stored(kinds.select("anchor", "segment", "copies", "one.*"), "segments")
    # stored, so that Spark can split hot anchors
    counts = stored(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")), "counts")
    most = max(1, hot_bytes // (2 * length - seed))
    kinds = stored(kinds.join(counts.hint("shuffle_hash"), "anchor").withColumn("hot", F.col("kinds") > most), "kinds")
    bytes_ = (F.col("lead") + F.col("tail")).cast("long") - F.when(F.col("kinds") == 1, length).otherwise(0)
    size, n_hot = kinds.agg(F.sum(F.when(~F.col("hot"), bytes_)), F.count_if("hot")).first()
    shards, tasks = max(1, -(-(size or 0) // shard_bytes)), max(1, -(-(size or 0) // TASK_BYTES))
    wanted = F.struct("at", "anchor", "segment", "copies", "hot", "lead", "tail", (F.col("kinds") == 1).alias("one"))
    asked = kinds.groupBy(F.col("doc_id").alias("_fs_doc"), F.col("text_hash").alias("_fs_hash")).agg(F.array_sort(F.collect_list(wanted)).alias("asked"))
    asked = asked.hint("shuffle_hash")
    member = pa.struct([("anchor", pa.int64()), ("segment", pa.int64()), ("from", pa.int32()), ("lead", pa.int32()), ("size", pa.int32())])

    def cut_out(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for t, wanted in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                group: list[dict] = []
                for w in [*wanted, None]:
                    follows = group and w and w["one"] and group[-1]["one"] and w["at"] - w["lead"] == group[-1]["at"] + group[-1]["tail"] - length + 1
                    if group and not (follows and w["at"] - group[0]["at"] < shard_bytes // 4):
                        first = group[0]["at"] - group[0]["lead"]
                        body = t[first : group[-1]["at"] + group[-1]["tail"]]
                        several = len(group) > 1
                        members = [{"anchor": g["anchor"], "segment": g["segment"], "from": g["at"] - g["lead"] - first, "lead": g["lead"], "size": g["lead"] + g["tail"]} for g in group]
                        g = group[0]
                        # in joined segments, all of whose windows repeat, distances to the first end stand for those to the anchors
                        for col, v in zip(out, (g["anchor"], g["segment"], g["copies"], len(body) - length if several else g["lead"], body, g["hot"], members)):
                            col.append(v)
                        group = []
                    if w:
                        group.append(w)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.list_(member))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["anchor", "segment", "copies", "lead", "bytes", "hot", "members"])

    named = rows.join(asked, (rows["text_hash"] == asked["_fs_hash"]) & rows["doc_id"].eqNullSafe(asked["_fs_doc"]))
    parts = named.select("text", "asked").mapInArrow(cut_out, "anchor bigint, segment bigint, copies bigint, lead int, bytes binary, hot boolean, members array<struct<anchor:bigint,segment:bigint,`from`:int,lead:int,size:int>>")
    beside = None
    if n_hot:
        parts = stored(parts, "parts")
        beside = hot_matches(parts.where("hot"), length)
        parts = parts.where("NOT hot")
    parts = parts.drop("hot").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).repartition(tasks, "shard").sortWithinPartitions("shard")

    def sort_shards(batches):
        def done(rows: list[tuple]):
            spans = matched([r[4] for r in rows], np.array([r[3] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), length, budget)
            keep: list[tuple] = []
            for r, (starts, ends) in zip(rows, spans):
                for m in r[5] if starts else ():
                    low, anchor = m["from"], m["from"] + m["lead"]
                    cut = [(max(s, low), min(e, low + m["size"])) for s, e in zip(starts, ends)]
                    cut = [(s - anchor, e - anchor) for s, e in cut if e - s >= length]
                    if cut:
                        keep.append((m["anchor"], m["segment"], [s for s, _ in cut], [e for _, e in cut]))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keep], kind) for i, kind in enumerate(kinds)], names=["anchor", "segment", "starts", "ends"])

        shard, rows = None, []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[6] != shard and rows:
                    yield done(rows)
                    rows = []
                shard = r[6]
                rows.append(r)
        if rows:
            yield done(rows)

    found = stored(parts.mapInArrow(sort_shards, "anchor bigint, segment bigint, starts array<int>, ends array<int>"), "matches")
    found = found if beside is None else found.unionByName(beside)
    back = shared.join(found.hint("shuffle_hash"), ["anchor", "segment"]).select("doc_id", "text_hash", "at", F.inline(F.arrays_zip("starts", "ends")))
    span = F.struct((F.col("at") + F.col("starts")).alias("start"), (F.col("at") + F.col("ends")).alias("end"))
    return back.groupBy("doc_id", "text_hash").agg(F.collect_set(span).alias("spans"))


def drop_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES, budget: int = BUDGET) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (merged, what was removed) and kept (the other bytes)."""
    spans = repeated_spans(docs, length, seed, shard_bytes, hot_bytes, budget)
    spans = spans.select(F.col("doc_id").alias("_fs_doc"), F.col("text_hash").alias("_fs_hash"), "spans").hint("shuffle_hash")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    joined = rows.join(spans, (rows["text_hash"] == spans["_fs_hash"]) & rows["doc_id"].eqNullSafe(spans["_fs_doc"]), "left")

    def cut(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            merged, kept = [], []
            for t, found in zip(texts, batch.column(2).to_pylist()):
                spans: list[list[int]] = []
                for s, e in sorted((x["start"], min(x["end"], len(t))) for x in found or ()):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([s, e])
                at, rest = 0, []
                for s, e in spans:
                    rest.append(t[at:s])
                    at = e
                rest.append(t[at:])
                merged.append([{"start": s, "end": e} for s, e in spans])
                kept.append(b"".join(rest))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(merged, kind), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    return joined.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id bigint, n_bytes bigint, spans array<struct<start:int,end:int>>, kept binary")


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


ORACLE = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
d2 AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
pos AS (SELECT doc_id, n, p, hash(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT doc_id, h, n, unnest(range(0, n - 199)) AS p FROM d2 WHERE n >= 200)),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS c FROM pos) WHERE c > 1),
cov AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM dup),
isl AS (SELECT doc_id, p, sum(CASE WHEN gap IS NULL OR gap > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM cov),
spans AS (SELECT doc_id, g, min(p) AS s, max(p) + 200 AS e FROM isl GROUP BY doc_id, g),
gaps AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS b FROM spans
  UNION ALL SELECT d2.doc_id, coalesce(max(e), 0), any_value(d2.n) FROM d2 LEFT JOIN spans ON d2.doc_id = spans.doc_id GROUP BY d2.doc_id),
kept AS (SELECT gaps.doc_id, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a) AS k FROM gaps JOIN d2 ON gaps.doc_id = d2.doc_id GROUP BY gaps.doc_id)
SELECT d2.doc_id, d2.n AS n_bytes, CAST(coalesce(r.m, 0) AS BIGINT) AS n_removed, CAST(coalesce(r.c, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.k)) AS kept_sha256
FROM d2 JOIN kept ON d2.doc_id = kept.doc_id LEFT JOIN (SELECT doc_id, sum(e - s) AS m, count(*) AS c FROM spans GROUP BY doc_id) r ON d2.doc_id = r.doc_id
"""
