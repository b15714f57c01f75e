"""Readers, writers and adapters of event tables."""
