"""marlgate.streaming: Structured Streaming pipelines."""
