"""Queries over the provided tables: domain views, catalogue and reference SQL."""
