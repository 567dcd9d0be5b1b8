"""docframe.sources."""
