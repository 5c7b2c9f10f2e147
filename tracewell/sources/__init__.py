"""Readers, the file catalogue and writers."""
