"""Relational operators over corpus tables: listing, joins, upserts, search."""
