"""The query catalogue over the driver tables."""
