"""Spark operators for URL corpora, indicator feeds, scored-model evaluation and log analytics."""
