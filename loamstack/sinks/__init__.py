"""Writes: projections, operations, commits and imports. One writer at a time; readers see whole generations."""
