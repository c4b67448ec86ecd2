"""All registered queries."""

from __future__ import annotations

from runloom.plans import queries_advice, queries_eval, queries_models, queries_runs, queries_stream

_PARTS = (queries_runs, queries_eval, queries_advice, queries_models, queries_stream)
QUERIES = {k: v for part in _PARTS for k, v in part.R.queries.items()}
