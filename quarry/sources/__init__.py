"""Readers, writers and the tables they produce."""
