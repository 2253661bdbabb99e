"""Registered queries with their SQL counterparts."""

from bandwalk.catalog import bars, ingest, liquidity, results, windows  # noqa: F401
from bandwalk.catalog.base import REGISTRY

__all__ = ["REGISTRY"]
