"""Behavioural analytics on Spark: trials, bouts, frequencies, comparisons."""
