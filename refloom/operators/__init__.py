"""DataFrame operators over reference graphs."""
