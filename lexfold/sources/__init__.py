"""Readers and writers of the data model's files."""
