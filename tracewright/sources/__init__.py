"""Scans, snapshot storage and sinks."""
