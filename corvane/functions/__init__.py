"""Column functions: text normalization, edit distance, alignment, script and metre, posterior arrays."""
