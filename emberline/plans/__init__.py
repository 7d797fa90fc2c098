"""Ready-made queries over the telemetry tables."""
