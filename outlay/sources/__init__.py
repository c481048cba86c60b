"""Readers and scans of the input tables and documents."""
