"""Structured Streaming: orchestration of CI events, ingest and report refresh."""
