"""docframe.streaming."""
