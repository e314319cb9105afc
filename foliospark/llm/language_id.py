"""Language identification by prediction by partial matching (PPM).

Every language has a byte context tree of up to ORDER bytes of context, counted on labelled texts and
then frozen. The code length of a byte after a context is PPM's (method C): with a symbol's count n_s, the
context's total n and number of distinct symbols q, coding costs log2((n + q) / n_s), an unseen symbol first an escape of
log2((n + q) / q) and then what the context shorter by a byte charges; below the empty context all 256
bytes cost 8 bits. A text's language is the one whose tree gives the whole text the shortest code.

As the statistics are frozen, the trees are flattened once per worker, whole: per order, each (context, symbol) that any tree has gets its
cost under every language, and each context the cost of an escape. Scoring a text is a lookup per byte, and one more per
escape, exact in every one.

Bounds (parameters): training takes at most SAMPLE_DOCS documents and SAMPLE_BYTES bytes per language, those with the
smallest hash of doc_id, leaving out those that no longer fit (where no text of a language fits, pieces from all over
one of them are taken), of the MAX_LANGS most frequent languages, and ALL_BYTES bytes in all. So model and tables are bounded whatever the corpus; nothing is
cut from the trees. Prediction reads whole texts, however long, in batches of about BATCH_BYTES.

The score is the probability of the language by the code lengths, tempered by the text's length:
softmax of minus the bits times TEMPER / sqrt(bytes). Bytes count as they are; the text is preceded by ORDER blanks.

Defined cases: null texts and texts without any letter are 'und' with score 0; rows without a lang or
with a null text don't train; without any training row everything is 'und'; ties go to the language
that sorts first; repeated rows are judged each, and train once; an empty table gives no rows, and with it nothing is learned; further columns play no part, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import LETTERS, local_table, lowest, spread, thrifty

ORDER = 3
SAMPLE_DOCS = 400
SAMPLE_BYTES = 2_000_000
MAX_LANGS = 1000
ALL_BYTES = 64_000_000
TEMPER = 1.0
BATCH_BYTES = 512 << 10
UNKNOWN = "und"


def has_letter(text: bytes) -> bool:
    return bool(LETTERS.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def train(texts: dict[str, list[bytes]], order: int = ORDER) -> dict:
    """Frozen counts: languages, alphabet, and per language and order the codes of (context, symbol) and their counts.

    Symbols are the bytes met in training, numbered from 1; 0 stands for all others.
    """
    langs = sorted(texts)
    if not langs:
        return {"langs": []}
    used = np.zeros(256, bool)
    used[0x20] = True
    for group in texts.values():
        for t in group:
            used[np.frombuffer(t, np.uint8)] = True
    symbol = np.zeros(256, np.int64)
    symbol[used] = np.arange(1, used.sum() + 1)
    size = int(used.sum()) + 1
    pad = b" " * order
    counts: list[list] = []
    for lang in langs:
        flat = symbol[np.frombuffer(b"".join(pad + t for t in texts[lang]), np.uint8)]
        real = np.concatenate([np.r_[np.zeros(order, bool), np.ones(len(t), bool)] for t in texts[lang]]) if texts[lang] else np.empty(0, bool)
        at = np.flatnonzero(real)
        per = []
        for k in range(order + 1):
            code = np.zeros(len(at), np.int64)
            for j in range(k, -1, -1):
                code = code * size + flat[at - j]
            per.append(np.unique(code, return_counts=True))
        counts.append(per)
    return {"langs": langs, "symbol": symbol, "size": size, "order": order, "counts": counts}


def flatten(model: dict) -> dict:
    """Per order: the number of a context by its code (-1: none has it), of a (context, symbol); bits of it, and of an escape, per language."""
    size, order, langs = model["size"], model["order"], model["langs"]
    levels = []
    for k in range(order + 1):
        codes = np.unique(np.concatenate([per[k][0] for per in model["counts"]])) if k else np.arange(size, dtype=np.int64)
        contexts = np.unique(codes // size)
        escape = np.zeros((len(contexts), len(langs)), np.float32)
        if k:
            low = levels[-1]
            lower = low["bits"][np.searchsorted(low["codes"], codes % size**k)]
        else:
            lower = np.full((size, len(langs)), 8.0, np.float32)
        bits = np.empty_like(lower)
        of = np.searchsorted(contexts, codes // size)
        for l, per in enumerate(model["counts"]):
            seen, n = per[k]
            ctx = np.searchsorted(contexts, seen // size)
            total, kinds = np.bincount(ctx, n, len(contexts)), np.bincount(ctx, minlength=len(contexts))
            has = kinds > 0
            escape[has, l] = np.log2((total[has] + kinds[has]) / kinds[has])
            bits[:, l] = lower[:, l] + escape[of, l]
            bits[np.searchsorted(codes, seen), l] = np.log2((total + kinds)[ctx] / n)
        context = np.full(size**k, -1, np.int32)
        context[contexts] = np.arange(len(contexts))
        pair = np.full(len(contexts) * size, -1, np.int32)
        pair[of * size + codes % size] = np.arange(len(codes))
        levels.append({"codes": codes, "context": context, "pair": pair, "bits": bits, "escape": escape})
    return {"levels": levels, "symbol": model["symbol"].astype(np.int32), "size": size, "order": order, "langs": langs}


def code_lengths(tables: dict, texts: list[bytes]) -> np.ndarray:
    """Bits of every text under every language: len(texts) x languages."""
    order, size, levels = tables["order"], tables["size"], tables["levels"]
    pad = b" " * order
    flat = tables["symbol"][np.frombuffer(b"".join(pad + t for t in texts), np.uint8)]
    lengths = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), len(tables["langs"])))
    if not len(flat):
        return out
    code = np.zeros(len(flat), np.int32)
    for j in range(order, 0, -1):
        code[order:] = code[order:] * size + flat[order - j : len(flat) - j]
    begin = np.cumsum(lengths + order) - lengths - order
    bits = np.zeros((len(flat), len(tables["langs"])), np.float32)
    real = np.ones(len(flat), bool)
    for j in range(order):  # the padding in front of each text costs nothing
        real[begin + j] = False
    todo = np.flatnonzero(real)
    for k in range(order, -1, -1):
        level = levels[k]
        context = level["context"][code[todo] % size**k]
        pair = np.where(context >= 0, level["pair"][np.maximum(context, 0) * size + flat[todo]], -1)
        hit = pair >= 0
        bits[todo[hit]] += level["bits"][pair[hit]]
        left = (context >= 0) & ~hit
        bits[todo[left]] += level["escape"][context[left]]
        todo = todo[~hit]
        if not len(todo):
            break
    # an empty text has its padding only
    return np.add.reduceat(bits, begin, axis=0, dtype=np.float64) if order else np.array([bits[b : b + n].sum(0, dtype=np.float64) for b, n in zip(begin, lengths)])


def _sample(docs: DataFrame, n_docs: int, n_bytes: int, max_langs: int = MAX_LANGS) -> dict[str, list[bytes]]:
    """lang to texts of its training sample, bounded per language by documents and bytes."""
    docs = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    h = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    keyed = docs.select("lang", "text", h.alias("h"), F.octet_length("text").alias("n"))
    fitting = lowest(keyed.where(F.col("n") <= n_bytes).select("lang", "h", "n"), "lang", n_docs, max_langs)
    have = {r["lang"] for r in fitting}
    only_long = keyed.where(F.col("n") > n_bytes).groupBy("lang").agg(F.min(F.struct("h", "n")).alias("one")).limit(max_langs).collect()
    chosen = [(r["lang"], r["one"]["h"], r["one"]["n"]) for r in only_long if r["lang"] not in have]
    room: dict[str, int] = {}
    n_bytes = min(n_bytes, ALL_BYTES // max(1, len(have) + len(chosen)))
    for r in fitting:
        left = room.setdefault(r["lang"], n_bytes)
        if r["n"] <= left:
            room[r["lang"]] = left - r["n"]
            chosen.append((r["lang"], r["h"], r["n"]))
    out: dict[str, list[bytes]] = {}
    if not chosen:
        return out
    asked = local_table(docs.sparkSession, chosen, "lang string, h long, n int")
    found = keyed.join(F.broadcast(asked), ["lang", "h", "n"], "left_semi").groupBy("lang", "h", "n").agg(F.min("text").alias("text"))
    for r in found.select("lang", "text").toLocalIterator():
        out.setdefault(r["lang"], []).extend(spread(r["text"].encode(), n_bytes))
    return out


def fit(docs: DataFrame, n_docs: int = SAMPLE_DOCS, n_bytes: int = SAMPLE_BYTES, order: int = ORDER) -> dict:
    """A model from labelled documents (doc_id, text, lang)."""
    return train(_sample(docs, n_docs, n_bytes), order)


def identify(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs with lang_pred, score and bits_per_byte."""
    keep = ["doc_id"] if keep is None else keep
    sent = docs.sparkSession.sparkContext.broadcast({"model": model})
    names = [f"_fs_{i}" for i in range(len(keep))]
    at_text = keep.index("text") if "text" in keep else len(keep)  # a text that is kept is sent once
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], *([] if at_text < len(keep) else [F.col("text").alias("_fs_text")]))

    def score(batches):
        got = sent.value
        if "tables" not in got:  # a worker keeps the broadcast value between tasks
            got["tables"] = flatten(got["model"]) if got["model"]["langs"] else {"langs": []}
            del got["model"]
        tables = got["tables"]
        langs = tables["langs"]
        most = min(BATCH_BYTES, max(1 << 12, (BATCH_BYTES << 4) // max(1, len(langs))))
        for batch in batches:
            texts = [t or b"" for t in batch.column(at_text).cast(pa.binary()).to_pylist()]
            ok = np.array([has_letter(t) for t in texts], bool) if langs else np.zeros(len(texts), bool)
            best, p, rate = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
            at, size = [], 0
            for k in np.flatnonzero(ok).tolist() + [-1]:
                if k >= 0:
                    at.append(k)
                    size += len(texts[k])
                if at and (k < 0 or size >= most):
                    bits = code_lengths(tables, [texts[i] for i in at])
                    n = np.array([len(texts[i]) for i in at], float)
                    ahead = np.exp((bits.min(1, keepdims=True) - bits) * (TEMPER / np.sqrt(n))[:, None])
                    best[at] = bits.argmin(1)
                    p[at] = 1.0 / ahead.sum(1)
                    rate[at] = bits.min(1) / n
                    at, size = [], 0
            said = [langs[b] if o else UNKNOWN for b, o in zip(best.tolist(), ok.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(said, pa.string()), pa.array(p), pa.array(rate)], names=[*names, "lang_pred", "score", "bits_per_byte"]
            )

    kinds = [f"{n} {plain.schema[n].dataType.simpleString()}" for n in names]
    out = plain.mapInArrow(thrifty(score), ", ".join([*kinds, "lang_pred string", "score double", "bits_per_byte double"]))
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "lang_pred", "score", "bits_per_byte")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def trained(docs: DataFrame) -> dict:
    return fit(docs.where(~F.coalesce(held_out(), F.lit(False))))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), trained(docs))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
