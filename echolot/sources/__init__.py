"""Readers and writers: checked tables, token corpora, tolerant logs."""
