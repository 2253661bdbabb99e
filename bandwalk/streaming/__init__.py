"""Incremental candle ingest."""
