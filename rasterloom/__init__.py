"""Image relations and corpus operators on Spark."""
