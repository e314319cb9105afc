"""Quality by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are trained on labelled texts, one on good and one on bad ones. A whole text is compressed with each;
the size with the bad dictionary less the size with the good one, over the sum of both, is its
feature: above 0 it resembles good text. Long texts outgrow a dictionary, so they are compressed piece
by piece, PIECE bytes each, every piece with the dictionary anew, and sizes add up: the whole text counts alike.
A logistic curve, fitted on labelled texts that trained no dictionary, turns the feature into a probability.

Bounds (parameters): at most SAMPLE_DOCS labels per class are used, those with the smallest hash of doc_id. Half of their texts train dictionaries, with
at most SAMPLE_BYTES bytes each (more where a class has so few that they would not fill a dictionary), in pieces from all over the text, and these pieces alone are sent to the driver. The other half train the curve: they are
compressed where they are, whole, and their features are sent.

Defined cases: null and empty texts have feature 0 and get the curve's value there; a doc_id with several
labels counts with each, one with several texts with the smallest of them; null labels and labels without a text don't count; if a class has too few texts to train a dictionary its texts become
the dictionary's content as they are; with a class missing every score is the share of good labels (0.5 without labels);
repeated rows are judged each; very long texts are compressed whole, piece by piece; an empty table gives no rows; further columns play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import local_table, lowest, spread, thrifty

SAMPLE_DOCS = 1500
SAMPLE_BYTES = 1000
DICT_BYTES = 64 << 10
LEVEL = 3
PIECE = 256
THRESHOLD = 0.3


def make_dictionary(texts: list[bytes], size: int = DICT_BYTES, piece: int = PIECE) -> bytes:
    """A dictionary as bytes; raw content where there is too little text to train on."""
    import zstandard as zstd

    pieces = [t[k : k + piece] for t in texts for k in range(0, len(t), piece)]
    try:
        return zstd.train_dictionary(size, pieces).as_bytes()
    except zstd.ZstdError:
        return b"".join(pieces)[-size:] or b" "


def features(texts: list[bytes], good, bad, piece: int = PIECE) -> np.ndarray:
    """(bytes with bad - bytes with good) / (both) per text. good, bad: zstandard compressors."""
    out = np.zeros(len(texts))
    for i, t in enumerate(texts):
        g = b = 0
        for k in range(0, len(t), piece):
            part = t[k : k + piece]
            g += len(good.compress(part))
            b += len(bad.compress(part))
        if g + b:
            out[i] = (b - g) / (b + g)
    return out


def compressors(good: bytes, bad: bytes, level: int = LEVEL):
    import zstandard as zstd

    made = []
    for d in (good, bad):
        held = zstd.ZstdCompressionDict(d)
        held.precompute_compress(level=level)
        made.append(zstd.ZstdCompressor(dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))
    return made


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of the logistic curve with the least log loss (slightly ridged Newton steps)."""
    scale = x.std() or 1.0
    design = np.c_[x / scale, np.ones(len(x))]
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 1e-3 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def _pieces(texts: DataFrame) -> DataFrame:
    """quality, k, pieces of texts (quality, k, text, most)."""

    def cut(batches):
        for batch in batches:
            got = [spread(t, n, PIECE) for t, n in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.binary()))], names=["quality", "k", "pieces"])

    return texts.select("quality", "k", "text", "most").mapInArrow(thrifty(cut), "quality int, k int, pieces array<binary>")


def fit(docs: DataFrame, labels: DataFrame, n_docs: int = SAMPLE_DOCS) -> dict:
    """A model from docs (doc_id, text) and labels (doc_id, quality)."""
    h = F.xxhash64(F.lit("quality"), F.col("doc_id"))
    named = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("quality").cast("int").alias("quality"), h.alias("h"), F.col("doc_id").cast("long").alias("doc_id"))
    chosen: dict = {0: [], 1: []}
    for r in lowest(named, "quality", n_docs, 2):
        chosen[r["quality"]].append(r["doc_id"])
    most = {q: max(SAMPLE_BYTES, DICT_BYTES // max(1, (len(ids) + 1) // 2)) for q, ids in chosen.items()}
    rows = [(d, q, k, most[q]) for q, ids in chosen.items() for k, d in enumerate(ids)]
    if not rows:
        return {"share": 0.5}
    few = local_table(docs.sparkSession, rows, "doc_id long, quality int, k int, most int")  # 2 * n_docs short rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id").where("text <> ''")
    texts = texts.groupBy("quality", "k", "most").agg(F.min("text").alias("text"))
    # every other text of a class, in the order of its hash, trains its dictionary
    got: dict = {0: [], 1: []}
    for r in _pieces(texts.where("k % 2 = 0")).orderBy("quality", "k").toLocalIterator():
        got[r["quality"]].extend(r["pieces"])
    if not got[0] or not got[1]:
        n = dict(texts.groupBy("quality").count().collect())
        return {"share": n.get(1, 0) / (n.get(0, 0) + n.get(1, 0)) if n else 0.5}
    model = {"good": make_dictionary(got[1]), "bad": make_dictionary(got[0]), "slope": 1.0, "offset": 0.0}
    curve = texts.where("k % 2 = 1")
    if curve.groupBy("quality").count().count() < 2:  # so few that all serve twice
        curve = texts
    seen = score_quality(curve.select((F.col("k") * 2 + F.col("quality")).alias("doc_id"), "text"), model).orderBy("doc_id").collect()
    model["slope"], model["offset"] = fit_curve(np.array([r["feature"] for r in seen]), np.array([r["doc_id"] % 2 for r in seen], float))
    return model


def score_quality(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, feature, score of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = sent.value
        pair = compressors(m["good"], m["bad"]) if "good" in m else None
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            x = features(texts, *pair) if pair else np.zeros(len(texts))
            p = 1 / (1 + np.exp(-np.clip(m["slope"] * x + m["offset"], -700, 700))) if pair else np.full(len(texts), m["share"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x), pa.array(p)], names=["doc_id", "feature", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(thrifty(score), "doc_id bigint, feature double, score double")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(~held_out()))
    out = score_quality(docs, model)
    return out.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
