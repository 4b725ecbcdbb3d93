"""Structured Streaming forms of the stateless filters, and windowed counts of an event stream (beyond the batch pipeline)."""
