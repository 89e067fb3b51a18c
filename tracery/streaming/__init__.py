"""Live refresh on Structured Streaming."""
