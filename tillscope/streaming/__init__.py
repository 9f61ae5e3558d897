"""Structured Streaming forms of the live and order audits."""
