"""Reading, deduplicating and storing candles, results and markets."""
