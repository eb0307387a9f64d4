"""Live forms of the measurement on Structured Streaming."""
