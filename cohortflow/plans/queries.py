"""All registered queries."""

from __future__ import annotations

from . import event_queries, io_queries, release_queries, scalar_queries, signal_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
