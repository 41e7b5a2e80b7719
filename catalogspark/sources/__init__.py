"""Readers, writers and the mapping of the given tables to catalogue tables."""
