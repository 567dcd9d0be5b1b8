"""docframe.formats."""
