"""Registry of the retrieval queries: name -> callable(spark, sf_dir), and DuckDB SQL for the same rows."""

from __future__ import annotations

from corpusloom.plans import eval_plans, page_plans, phase_plans, query_plans, report_plans, search_plans, text_plans, trace_plans  # noqa: F401  (registers its queries)
from corpusloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
