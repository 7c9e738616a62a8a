"""Streaming forms of the epoch and event operators."""
