"""Readers and the run store."""
