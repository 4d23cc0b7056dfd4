"""Readers: SAM text, GTF, gene BED, candidate tables, event tables. Schemas are explicit; nothing is inferred from data."""
