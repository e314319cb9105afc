"""The named queries beside their SQL, on the smallest tables; plans that must not lose their shape."""

from __future__ import annotations

import contextlib
import io
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
import compare
from foliospark.operators import catalog
from foliospark.plans import bindings as B
from foliospark.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        failed = compare.main(["--sf", SF, name])
    assert failed == 0, out.getvalue()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "score"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keyword_rules_join_nothing(spark):
    p = plan(queries.rule_hits(spark, SF))
    assert "NestedLoop" not in p and "CartesianProduct" not in p and "Join" not in p


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "foliospark", tmp_path / "foliospark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "foliospark" / "llm" / "__pycache__").mkdir(parents=True)  # what a deletion may leave
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = set(e.queries()); assert n and set(e.oracle_sql()) <= n and not any(q.startswith('op') and q[2].isdigit() for q in n)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0


def test_scans_are_pruned_and_limits_pushed(spark):
    p = plan(queries.list_recent(spark, SF))
    assert "TakeOrderedAndProject" in p
    p = plan(catalog.find(B.table(spark, SF, "documents").withColumnRenamed("lang", "status"), status="de").select("doc_id"))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in p and "PushedFilters: [IsNotNull(lang), EqualTo(lang,de)]" in p
