"""Dataflows over pages, links, sources and operations."""
