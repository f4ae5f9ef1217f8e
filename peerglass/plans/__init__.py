"""Compositions of the operators; windows and combinations are keys, never loops."""
