"""Readers, writers and snapshot tables."""
