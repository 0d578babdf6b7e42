"""Sales-matching data jobs on Spark."""
