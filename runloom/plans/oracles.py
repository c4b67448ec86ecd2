"""SQL twins of all registered queries."""

from __future__ import annotations

from runloom.plans.catalog import _PARTS

ORACLES = {k: v for part in _PARTS for k, v in part.R.oracles.items()}
