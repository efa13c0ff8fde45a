"""streaming of tidewright."""
