"""Column expressions: spectra, metadata, vectors, bits, scores, keys."""
