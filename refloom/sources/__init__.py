"""Readers and writers: project trees, relational tables, report sinks."""
