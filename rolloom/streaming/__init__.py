"""The same steps under Structured Streaming."""
