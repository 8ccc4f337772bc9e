"""Value standardization on Spark."""
