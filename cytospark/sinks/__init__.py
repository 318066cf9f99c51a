"""Text formats, the M-bias plot, and files that are replaced all together or not at all."""
