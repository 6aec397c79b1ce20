"""Building-telemetry analytics on Spark: rules, alignment, metering and findings."""
