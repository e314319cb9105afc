"""Near-duplicate detection with BagMinHash signatures, banding and exact verification.

A document is the multiset of its runs of SHINGLE words (a shorter text: its one run). Two documents are linked
if sum(min) / sum(max) of the multiplicities is at least THRESHOLD; classes are the connected components.

Signatures (Ertl's BagMinHash): a shingle's weight axis is cut into the dyadic levels [0,1), [1,2), [2,4) ...,
each with a Poisson process of its own of rate M per unit, seeded by (shingle, level). A point has a time,
a component 1..M and a place on the weight axis, uniform in its level (32 bits, drawn at once: the levels are not halved
further, as points of a level that the weight cuts are few); it counts for a document if the place is below the document's weight. Component k of the signature is the first time at k. Two
documents agree in a component with probability equal to their weighted Jaccard similarity. Processes
are followed only up to a time by which all components have most likely been met; where not, the time
is doubled. So about M ln M points are made per document, whatever its length.

Linking: documents with the same shingle sequence are one class from the start. The others share a bucket
if they agree in all ROWS components of one of BANDS bands. Buckets are not expanded into all
pairs. Each names a leader, its member with the most company, and all are compared with it: a bucket of
copies of one text costs one comparison per member, and most buckets are of one component then. In
those that are not, members of different components are compared block by block, apart from pairs that
their distances to the leader rule out. A pair of a bucket is thus compared unless it is connected already or
can't be linked: no link between classes is lost. Buckets, blocks, links and components stay distributed; hot buckets
are aggregated map-side and joined with joins that Spark may split.

Defined cases: null and empty texts, and texts without a word, are classes of their own, one per row; fully repeated rows are
documents of one class, of which one can stay; a null
doc_id is allowed; class_id is the smallest doc_id of the class (null only if all are null); ties between rows of the smallest doc_id go by the hash of the text; very long texts are hashed
whole, and held whole by the task that compares them; an empty table gives no rows; further columns play no part, whatever their names, and near_dedup gives them back as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import TEXT_ROWS, WORD_BYTES, batch_rows, mix64, small, stored, thrifty

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
M = BANDS * ROWS
BATCH_BYTES = 1 << 20
#: Members in a block, and slices of the distance to a leader.
BLOCK, SLICES = 64, 20
#: Pairs whose shingles are in memory together.
PAIRS = 256
#: Distinct shingles of a block's texts, 16 bytes each, that a task keeps from one comparison of blocks to the next.
HELD = 1 << 20

_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word of each text, one after another; the number of words of each text."""
    from collections import defaultdict
    from itertools import count

    import xxhash

    number = defaultdict(count().__next__)
    parts, lengths = [], []
    for t in texts:
        w = t.translate(WORD_BYTES).split()
        lengths.append(len(w))
        parts.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return each[flat], np.array(lengths, np.int64)


def shingles(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, and how many each text has."""
    words, n = word_hashes(texts)
    many = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    total = int(many.sum())
    if not total:
        return np.empty(0, np.uint64), many
    start = np.repeat(np.cumsum(n) - n, many) + np.arange(total) - np.repeat(np.cumsum(many) - many, many)
    width = np.repeat(np.minimum(n, k), many)
    h = np.zeros(total, np.uint64)
    padded = np.append(words, np.zeros(k, np.uint64))
    short = bool((n < k).any())
    for j in range(k):
        w = padded[start + j]
        if short:
            w = np.where(j < width, w, np.uint64(0))
        h = (h ^ w) * _B + np.uint64(j + 1)
        h ^= h >> np.uint64(29)
    return mix64(h), many


def multisets(hashes: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, shingle, multiplicity), sorted by document and shingle."""
    doc = np.repeat(np.arange(len(many)), many)
    ends = np.cumsum(many)
    h = hashes.copy()
    for s, e in zip((ends - many).tolist(), ends.tolist()):
        h[s:e].sort()
    if not len(h):
        return doc, h, np.empty(0, np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def bag_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int = M) -> np.ndarray:
    """Signatures, n_docs x m first times; infinite for a document without elements."""
    out = np.full(n_docs * m, np.inf)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    limit = np.full(n_docs, np.inf)
    has = total > 0
    limit[has] = (np.log(m) + 2.0) / total[has]
    # processes: one per element and dyadic level below its weight
    proc_doc, seed, low, span, top = [], [], [], [], []
    level, rest = 0, np.arange(len(doc))
    while len(rest):
        lo = 0.0 if level == 0 else float(1 << (level - 1))
        width = 1.0 if level == 0 else lo
        proc_doc.append(doc[rest])
        seed.append(mix64(element[rest] ^ mix64(np.full(1, level, np.uint64))[0]))
        low.append(np.full(len(rest), lo))
        span.append(np.full(len(rest), width))
        top.append(weight[rest].astype(float))
        rest = rest[weight[rest] > lo + width]
        level += 1
    proc_doc, seed, low, span, top = (np.concatenate(x) if x else np.empty(0) for x in (proc_doc, seed, low, span, top))
    proc_doc = proc_doc.astype(np.int64)
    seed = seed.astype(np.uint64)
    todo = np.arange(len(proc_doc))
    while len(todo):
        d, s, lo, w, t = proc_doc[todo], seed[todo], low[todo], span[todo], top[todo]
        time, bound = np.zeros(len(todo)), limit[d]
        step = 0
        while len(d):
            r = mix64(s + np.uint64(step * int(_C) % (1 << 64)))
            # 53 bits of a never-zero uniform number; the exponential gap to the next point
            time = time - np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / (m * w)
            near = time <= bound
            d, s, lo, w, t, time, bound, r = (x[near] for x in (d, s, lo, w, t, time, bound, r))
            if not len(d):
                break
            q = mix64(r)
            k = ((q >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
            whole = lo + w <= t
            if whole.all():
                np.minimum.at(out, d * m + k, time)
            else:  # halving the level 32 times gives the bits of the point's place in it
                place = lo + w * ((q & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32)
                ok = whole | (place < t)
                np.minimum.at(out, (d * m + k)[ok], time[ok])
            step += 1
        unmet = np.isinf(out.reshape(n_docs, m)).any(axis=1) & has
        limit = np.where(unmet, limit * 2, limit)
        todo = np.flatnonzero(unmet[proc_doc])
    return out.reshape(n_docs, m)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
    for j in range(rows):
        h = mix64(h ^ bits[:, :, j])
    return h.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """sum(min) / sum(max) of two multisets, each (sorted distinct shingles, multiplicities)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    low = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    high = int(a[1].sum() + b[1].sum()) - low
    return low / high if high else 0.0


def _chunks(batches, limit: int):
    """Lists of column values with about limit bytes of text; the text column is the last."""
    cols: list[list] = []
    size = 0
    for batch in batches:
        got = [c.to_pylist() for c in batch.columns[:-1]] + [batch.columns[-1].cast(pa.binary()).to_pylist()]
        cols = cols or [[] for _ in got]
        for row in zip(*got):
            for c, v in zip(cols, row):
                c.append(v)
            cols[-1][-1] = cols[-1][-1] or b""
            size += len(cols[-1][-1]) + 64
            if size >= limit:
                yield cols
                cols, size = [[] for _ in got], 0
    if cols and cols[0]:
        yield cols


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, sequence (hash of the shingle sequence), bands, row_no; stored."""
    schema = "doc_id bigint, text_hash bigint, n_shingles int, sequence binary, bands array<bigint>"

    def sign(batches):
        import xxhash

        for ids, hashes, texts in _chunks(batches, BATCH_BYTES):
            h, many = shingles(texts)
            sig = band_keys(bag_minhash(*multisets(h, many), len(texts)))
            ends = np.cumsum(many).tolist()
            seq = [xxhash.xxh3_128_digest(h[e - n : e].tobytes()) for e, n in zip(ends, many.tolist())]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(sig.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(many.astype(np.int32)), pa.array(seq, pa.binary()), bands],
                names=["doc_id", "text_hash", "n_shingles", "sequence", "bands"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    with batch_rows(docs.sparkSession, TEXT_ROWS):
        return stored(rows.mapInArrow(thrifty(sign), schema).withColumn("row_no", F.monotonically_increasing_id()), "signatures")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node) for the nodes of edges (a, b): rounds of large-star and small-star."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stored(edges, "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges = stored(small, "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("comp")), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def _bags(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    d, e, w = multisets(*shingles(texts))
    cut = np.searchsorted(d, np.arange(len(texts) + 1))
    return [(e[s:t], w[s:t]) for s, t in zip(cut[:-1].tolist(), cut[1:].tolist())]


def _with_leaders(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """node, leader and their similarity, for pairs (node, leader). texts: node, text, of all of them."""

    def verify(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS):
                part = batch.slice(at, PAIRS)
                a, b = (part.column(k).to_pylist() for k in (0, 1))
                ta, tb = (part.column(k).cast(pa.binary()).to_pylist() for k in (2, 3))
                fresh = {**dict(zip(a, ta)), **dict(zip(b, tb))}
                bag = dict(zip(fresh, _bags(list(fresh.values()))))
                found = [similarity(bag[x], bag[y]) for x, y in zip(a, b)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.float64())], names=["node", "leader", "sim"])

    own = texts.select("node", F.col("text").alias("own_text"))
    other = texts.select(F.col("node").alias("leader"), F.col("text").alias("leader_text"))
    rows = pairs.join(own, "node").join(other, "leader").select("node", "leader", "own_text", "leader_text")
    return rows.mapInArrow(thrifty(verify), "node bigint, leader bigint, sim double")


def _between_blocks(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The links (a, b) between members of one bucket that are of different components.

    members: bucket, band, node, comp, far (1 - similarity to the bucket's leader). A bucket's members are dealt to blocks of about
    BLOCK, apart by whether they are of the largest component and by slices of far. Blocks meet if their slices allow a link
    (distances to the leader differ by 1 - threshold at most, as this distance is a metric) and they aren't both of the largest
    component. A pair is looked at in the first band that it shares.
    """
    sizes = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max_by("comp", "n").alias("main"))
    sliced = members.join(largest, "bucket").select(
        "bucket", "band", "node", "comp", (F.col("comp") == F.col("main")).alias("inner"), F.floor(F.col("far") * SLICES).cast("int").alias("slice")
    )
    many = sliced.groupBy("bucket", "inner", "slice").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = sliced.join(many, ["bucket", "inner", "slice"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    blocks = dealt.join(texts, "node").groupBy("bucket", "band", "inner", "slice", "block").agg(
        F.collect_list("node").alias("nodes"), F.collect_list("comp").alias("comps"), F.collect_list("bands").alias("bands"), F.collect_list("text").alias("texts")
    )
    blocks = stored(blocks, "blocks")
    near = int(np.ceil((1 - threshold) * SLICES - 1e-9)) + 1
    left = blocks.where("NOT inner").select("bucket", "band", *[F.col(c).alias(f"l_{c}") for c in ("slice", "block", "nodes", "comps", "bands", "texts")])
    right = blocks.select("bucket", *[F.col(c).alias(f"r_{c}") for c in ("inner", "slice", "block", "nodes", "comps", "bands", "texts")])
    met = left.join(right, "bucket").where(
        (F.abs(F.col("l_slice") - F.col("r_slice")) <= near)
        & (F.col("r_inner") | (F.struct("l_slice", "l_block") <= F.struct("r_slice", "r_block")))
    )

    def verify(batches):
        bag: dict = {}
        held = 0
        for batch in batches:
            a, b = [], []
            for at in range(batch.num_rows):  # a row holds the texts of two blocks, so one is unpacked at a time
                row = batch.slice(at, 1).to_pylist()[0]
                band, texts = row["band"], {}
                for side in "lr":
                    texts |= dict(zip(row[f"{side}_nodes"], row[f"{side}_texts"]))
                new = [n for n in texts if n not in bag]
                if held > HELD:
                    bag, new, held = {}, list(texts), 0
                fresh = dict(zip(new, _bags([texts[n].encode() for n in new])))
                held += sum(len(e) for e, _ in fresh.values())
                bag |= fresh
                ours, theirs = (np.array(row[f"{side}_bands"], np.int64) for side in "lr")
                first = (ours[:, None, :] == theirs[None, :, :]).argmax(2)
                other = np.array(row["l_comps"])[:, None] != np.array(row["r_comps"])[None, :]
                for i, j in zip(*(x.tolist() for x in np.nonzero((first == band) & other))):
                    x, y = row["l_nodes"][i], row["r_nodes"][j]
                    if similarity(bag[x], bag[y]) >= threshold:
                        a.append(min(x, y))
                        b.append(max(x, y))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    columns = ["band", *[f"{side}_{c}" for side in "lr" for c in ("nodes", "comps", "bands", "texts")]]
    return met.select(*columns).mapInArrow(thrifty(verify), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, text_hash, class_id, class_size, kept."""
    signed = signatures(docs)
    keyed = signed.where("n_shingles > 0")
    # one node for the documents with the same shingle sequence
    alike = keyed.groupBy("sequence").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.min("bands").alias("bands"))
    nodes = stored(alike.select("sequence", "first", "bands", F.monotonically_increasing_id().alias("node")), "nodes")
    member = nodes.select("node", F.posexplode("bands").alias("band", "key")).select("node", "band", F.xxhash64("band", "key").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(member.join(shared, "bucket"), "buckets")
    first = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "bands", "first.doc_id", "first.text_hash")
    left = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    texts = left.join(
        first.hint("shuffle_hash"), left["doc_id"].eqNullSafe(first["doc_id"]) & (left["text_hash"] == first["text_hash"])
    ).select("node", "bands", "text")
    texts = stored(texts.dropDuplicates(["node"]), "texts")  # fully repeated rows
    # the leader of a bucket is its member with the most company over all bands: copies gather around their original
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    head = members.join(company, "node").groupBy("bucket").agg(F.max_by("node", F.struct("company", "node")).alias("leader"))
    led = stored(members.select("bucket", "band", "node").join(head, "bucket"), "led")
    pairs = led.where("node <> leader").select("node", "leader").distinct()
    with batch_rows(docs.sparkSession, 2 * PAIRS):
        compared = stored(_with_leaders(pairs, texts), "compared")
    links = compared.where(F.col("sim") >= threshold).select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    comp = stored(components(links), "components")
    # what is left of a bucket without its leader, if it is of several components
    rest = led.where("node <> leader").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = rest.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    rest = rest.join(mixed, "bucket").join(compared, ["node", "leader"]).select("bucket", "band", "node", "comp", (1 - F.col("sim")).alias("far"))
    rest = stored(rest, "open")
    with batch_rows(docs.sparkSession, BLOCK):
        more = stored(_between_blocks(rest, texts.select("node", "bands", "text"), threshold), "links")
    if not more.isEmpty():
        comp = stored(components(links.unionByName(more)), "components")
    rows = keyed.select("doc_id", "text_hash", "sequence", "row_no")
    classed = (
        rows.join(nodes.select("sequence", "node"), "sequence")
        .join(comp, "node", "left")
        .select("doc_id", "text_hash", "row_no", F.coalesce("comp", "node").alias("class"))
    )
    named = classed.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.min(F.struct("doc_id", "text_hash", "row_no")).alias("best"))
    out = classed.join(named, "class").select("doc_id", "text_hash", "class_id", "class_size", (F.col("best.row_no") == F.col("row_no")).alias("kept"))
    alone = signed.where("n_shingles = 0")
    return out.unionByName(alone.select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept")))


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class: the one with the smallest doc_id. Fully repeated rows with words stay once."""
    classes = near_duplicates(docs, threshold)
    fate = classes.groupBy(F.col("doc_id").alias("_fs_doc"), F.col("text_hash").alias("_fs_hash")).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"), F.max("class_size").alias("size"))
    fate = stored(fate.where("NOT kept OR (n > 1 AND size > 1)"), "fate")
    marked = docs.withColumn("_fs_text", F.xxhash64("text"))

    def on(keys: DataFrame):
        return (marked["_fs_text"] == keys["_fs_hash"]) & marked["doc_id"].eqNullSafe(keys["_fs_doc"])

    gone = small(fate.select("_fs_doc", "_fs_hash"))
    rest = marked.join(gone, on(gone), "left_anti").select(*docs.columns)
    again = fate.where("kept").select("_fs_doc", "_fs_hash")
    if again.isEmpty():
        return rest
    again = small(again)
    once = marked.join(again, on(again), "left_semi").dropDuplicates(["doc_id", "_fs_text"]).select(*docs.columns)
    return rest.unionByName(once)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "class_id", "class_size", "kept")
