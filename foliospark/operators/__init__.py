"""Operators over pages, blocks, chunks and translations."""
