"""Readers: text lines, request files, stored segments, spool files, configuration, growing files."""
