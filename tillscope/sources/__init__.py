"""Readers for landed tables, fixture derivations, the order feed, and sinks."""
