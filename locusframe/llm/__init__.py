"""Operators for preparing training text at corpus scale.

Nothing else in the library imports this subpackage. Every operator takes DataFrames, reads only the
identifier and text columns that it is told about (other columns never clash with its own names),
treats a null text as an empty one unless it says otherwise, and accepts empty tables.
"""
