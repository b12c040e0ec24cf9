"""Whole flows over several operators."""
