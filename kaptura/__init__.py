"""A transcript analytics engine for Spark."""
