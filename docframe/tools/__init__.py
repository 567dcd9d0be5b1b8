"""docframe.tools."""
