"""Readers, writers and derived series."""
