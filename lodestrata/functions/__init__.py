"""Column functions: sample types, block keys, vectors, quantisation and colour."""
