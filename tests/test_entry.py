"""The entry module imports without a session, and every registered query has a name of its own and runs."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from corpusloom.plans.registry import ORACLE_SQL, QUERIES

ROOT = str(Path(__file__).resolve().parent.parent)


def test_import_without_a_session():
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout) >= len(QUERIES)


def test_sql_belongs_to_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["scan_corpus", "normalize_line", "chunk_documents", "detect_domain", "hybrid_search", "authority_balance", "answer", "validate_synthesis", "quote_dump", "run_eval", "file_fingerprint", "scorecard_markdown", "worst_reanswered"])
def test_query_returns_rows(spark, small, name):
    df = QUERIES[name](spark, small)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0
