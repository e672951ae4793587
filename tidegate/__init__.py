"""Index-time event analytics on Spark: gates, interval joins, rules, metrics and disclosure control."""
