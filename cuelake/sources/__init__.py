"""Readers and writers for the file formats of the caption data model."""
