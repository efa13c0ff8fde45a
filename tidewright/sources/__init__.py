"""sources of tidewright."""
