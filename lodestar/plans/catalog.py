"""All queries over the code graph, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from lodestar.plans import code_queries, graph_queries, resolve_queries, search_queries, store_queries, text_queries  # noqa: F401
from lodestar.plans.registry import ORACLES, QUERIES  # noqa: F401
