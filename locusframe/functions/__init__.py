"""Column functions: CIGAR strings, supplementary-alignment tags, attributes, naming."""
