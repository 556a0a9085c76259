"""Resumable evaluation as a stream."""
