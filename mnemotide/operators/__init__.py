"""Relational, text, graph and retrieval operators."""
