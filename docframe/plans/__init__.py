"""docframe.plans."""
