"""Column-level functions: rule scalars, hashing, checksums, formats, text."""
