"""Usage telemetry analytics on Spark."""
