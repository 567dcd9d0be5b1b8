"""docframe.functions."""
