"""Whole workflows, and the registered queries over the driver's tables."""
