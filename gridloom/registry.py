"""Queries over the driver's tables: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from gridloom.plans import base, details, grids, similarity, statistics, studies, tables, training

QUERIES = dict(base.QUERIES)
ORACLES = dict(base.ORACLES)
assert all((details, similarity, tables, grids, statistics, studies, training))  # importing them registers their queries
