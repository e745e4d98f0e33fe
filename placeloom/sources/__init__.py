"""Readers, writers and the bindings of the test tables."""
