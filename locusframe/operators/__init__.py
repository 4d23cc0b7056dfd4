"""Operators on alignments, observations, candidates and intervals."""
