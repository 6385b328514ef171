"""Whole plans made of the operators, and the catalogue of checkable queries."""
