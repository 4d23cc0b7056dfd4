"""Writers: tab-separated tables, VCF, gene BED, summaries."""
