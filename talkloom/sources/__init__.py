"""Sources, sinks and shared scratch tables."""
