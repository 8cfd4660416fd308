"""Readers, writers and static registries."""
