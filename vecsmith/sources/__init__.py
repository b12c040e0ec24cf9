"""Readers and sinks: documents, vector files, metadata, snapshots."""
