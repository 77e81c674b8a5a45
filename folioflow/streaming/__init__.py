"""Incremental runs over arriving documents."""
