"""Resumable copies and recurring checks on Structured Streaming."""
