"""Operators over fact memories, as DataFrame transformations."""
