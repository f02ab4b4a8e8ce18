"""Readers, regular panels from raw rows, and writers."""
