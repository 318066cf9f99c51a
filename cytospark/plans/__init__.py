"""The four analyses, as DataFrames."""
