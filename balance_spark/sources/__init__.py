"""Readers, writers and dimensions."""
