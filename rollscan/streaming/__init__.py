"""Live inspection with Structured Streaming."""
