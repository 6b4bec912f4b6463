"""Scans and sinks: driver tables, file trees, info files, logs, JSON documents."""
