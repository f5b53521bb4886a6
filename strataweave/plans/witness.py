"""All queries of the reference's operators."""

from __future__ import annotations

from . import evaluation_queries, graph_queries, ledger_queries, memory_queries, more_queries, recall_queries, set_queries, text_queries, write_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
