"""Readers of corpus files and the catalog of corpora."""
