"""plans of tidewright."""
