"""Analyses of files as they arrive."""
