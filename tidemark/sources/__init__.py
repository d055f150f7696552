"""Readers and writers of segment files, Avro files and manifest tables."""
