"""Readers and writers of binary record files."""
