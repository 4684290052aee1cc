"""Profile, map, copy and prove tables with Spark."""
