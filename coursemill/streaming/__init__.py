"""Structured Streaming forms of the ordered operators; the batch forms are in `operators`."""
