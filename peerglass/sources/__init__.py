"""Readers, sinks and mappings onto the table contract."""
