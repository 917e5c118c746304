"""Readers, writers and catalog operations."""
