"""Readers of alignments, references, intervals and site metrics."""
