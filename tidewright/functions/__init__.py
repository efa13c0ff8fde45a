"""functions of tidewright."""
