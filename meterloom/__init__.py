"""Usage analytics for AI-tool logs, written as Spark DataFrame jobs."""
