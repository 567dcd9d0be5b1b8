"""docframe.llm."""
