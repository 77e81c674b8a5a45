"""Readers of source documents, page images, page files and caches."""
