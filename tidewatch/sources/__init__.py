"""Readers, writers and column naming for the supported log formats."""
