"""DataFrame operators over evidence tables."""
