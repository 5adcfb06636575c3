"""From analyzers to Spark jobs."""
