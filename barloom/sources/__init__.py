"""Readers and writers of bar series."""
