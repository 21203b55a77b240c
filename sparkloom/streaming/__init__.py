"""Structured Streaming: windowed aggregation, sessions, deduplication, running state and watermark loads."""
