"""Operators that also run on a stream."""
