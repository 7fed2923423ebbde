"""Evidence tables on Spark: exact measurement algebra, typed filters, statistics and text operators."""
