"""Readers and writers for code trees, archives, tables and run outputs."""
