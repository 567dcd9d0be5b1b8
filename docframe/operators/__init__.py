"""docframe.operators."""
