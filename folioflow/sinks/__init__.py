"""Writers of page files, summaries, caches and images."""
