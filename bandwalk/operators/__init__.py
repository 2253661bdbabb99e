"""Operators over bars, results, trials and order books."""
