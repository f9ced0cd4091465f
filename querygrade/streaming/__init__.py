"""Streaming forms of the stateless columns, of delta assembly and of the cache."""
