"""Operators for building language-model training data.

Nothing outside this subpackage imports it; ``queries.py`` lists the queries
and SQL that the driver entry adds when the subpackage is present.
"""
