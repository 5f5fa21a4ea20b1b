"""Spark-first sequencing-run analytics: interval, read, methylation, copy-number and score operators."""
