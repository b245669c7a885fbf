"""Sources, sinks and provenance."""
