"""Corpus analytics on Spark: catalogue, lineage, reconciliation, event-log and text operators."""
