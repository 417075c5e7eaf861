"""Queries, configuration and the experiment's stages."""
