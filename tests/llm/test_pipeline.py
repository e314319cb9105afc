"""The pipeline against its stages' definitions, on whole tables."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as p
from foliospark.llm import common, decontamination, near_dedup
from test_corpus_operators import brute_classes, words

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_effective(spark):
    assert [n for n, _ in p.STAGES] == ["language ID", "exact dedup", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    for k, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, SF)
        if k < len(p.STAGES) - 1:
            assert out.columns == docs.columns
            docs = p.stored(out, f"test{k}")
            seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[1] > seen[2]
    by_hand = sorted(map(tuple, out.select("doc_id", "copy_no").collect()))
    assert by_hand == sorted(map(tuple, p.run(spark, SF).select("doc_id", "copy_no").collect()))
    kept = {d for d, _ in by_hand}
    assert kept <= {r.doc_id for r in docs.collect()}


def test_stages_take_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, class_id long"
    rows = [(1, None, None, None, None, True, 1), (2, "", "en", "a", 0, True, 1), (3, "Ein Satz mit Worten", "de", None, 19, True, 1), (3, "Ein Satz mit Worten", "de", None, 19, True, 1), (4, "!!!", "en", "b", 3, True, 1)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for k, (_, stage) in enumerate(p.STAGES):
            out = stage(spark, docs, SF)
            docs = p.stored(out, f"odd{k}")
            assert docs.columns[: len(schema.split(","))] == [c.split()[0] for c in schema.split(", ")]
        assert Counter(r.doc_id for r in docs.collect()).keys() <= {3}


def test_language_stage_rejects_noise_and_keeps_unlabelled_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(5)
    rows = [(-1 - i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=400)), None) for i in range(5)]
    more = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    lettered = {r.doc_id for r in docs.where(F.col("text").rlike(r"\p{L}")).collect()}
    kept = {r.doc_id for r in p.language_id(spark, more, SF).collect()}
    assert not {r[0] for r in rows} & kept and len(lettered - kept) <= 0.001 * len(lettered)
    bare = spark.createDataFrame([(1, "Ein Satz", None), (2, "!!!", None), (3, None, None), (4, "\u0661 \u00e9", None)], docs.schema)
    assert {r.doc_id for r in p.language_id(spark, bare, SF).collect()} == {1, 4}


def test_runs_do_not_touch_each_other(spark):
    first, second = p.run(spark, SF), p.run(spark, SF)
    n = second.count()
    assert n == first.count() > 0


def test_stage_values_on_a_small_table(spark):
    """Each stage against its definition, row by row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    lettered = {r.doc_id for r in rows if any(c.isalpha() for c in r.text or "")}
    one = p.language_id(spark, docs, SF).collect()
    assert {r.doc_id for r in one} == lettered  # too few labelled texts for a bound
    two = p.exact_copies(spark, spark.createDataFrame(one, docs.schema), SF).collect()
    best: dict = {}
    for r in one:
        key = r.text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        best[key] = max(best.get(key, -1), r.doc_id)
    assert sorted(r.doc_id for r in two) == sorted(best.values())
    three = p.near_copies(spark, spark.createDataFrame(two, docs.schema), SF).collect()
    groups = brute_classes([(r.doc_id, r.text) for r in two])
    assert sorted(r.doc_id for r in three) == sorted(min(d for d, _ in g) for g in groups)
    four = p.benchmark_leaks(spark, spark.createDataFrame(three, docs.schema), SF).collect()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    grams = {tuple(b[k : k + 10]) for _, t in items for b in [words(t)] for k in range(max(1, len(b) - 9) if b else 0)}
    sizes = {len(g) for g in grams}
    leaky = {r.doc_id for r in three for w in [words(r.text)] for n in sizes if any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1))}
    assert sorted(r.doc_id for r in four) == sorted({r.doc_id for r in three} - leaky)
    assert 0 < len(four) < len(three) < len(two) < len(rows)


def test_stages_send_small_arrow_batches_and_no_text_twice(spark, monkeypatch):
    """Memory outside the heap: what a stage sends to Python, and that nothing but Arrow functions starts workers there."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = p.language_id(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "_fs_text" not in plan
    few = common.local_table(spark, [("de", 1, None), (None, 2, 3)], "lang string, h long, n int")
    assert "ExistingRDD" not in few._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in few.collect()] == [("de", 1, None), (None, 2, 3)] and few.dtypes == [("lang", "string"), ("h", "bigint"), ("n", "int")]
    assert common.local_table(spark, [], "a int").count() == 0
    sent: dict = {}

    def noted(df, name, write=common.stored):
        sent[name] = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return write(df, name)

    for module in (decontamination, near_dedup):
        monkeypatch.setattr(module, "stored", noted)
    p.near_copies(spark, docs, SF)
    p.benchmark_leaks(spark, docs, SF)
    assert sent["signatures"] == sent["postings"] == common.TEXT_ROWS and sent["terms"] == sent["hits"] == 1
