"""Operators over page and document tables."""
