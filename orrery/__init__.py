"""Analysis of particle snapshots on Spark."""
