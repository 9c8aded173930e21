"""Topic analytics over time-stamped text, written as Spark DataFrame jobs."""
