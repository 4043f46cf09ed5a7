"""Transaction monitoring on Spark: window rules, behavioural features, scoring and alerts."""
