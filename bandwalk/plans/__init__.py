"""Multi-operator jobs: grid scans, trial logs, final backtests."""
