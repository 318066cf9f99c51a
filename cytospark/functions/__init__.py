"""Column functions: flags and strands, CIGARs, base calls, contexts, intervals of confidence and text."""
