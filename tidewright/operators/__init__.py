"""operators of tidewright."""
