"""Scans, sinks and the shared staging area."""
