"""Readers of the file kinds."""
