"""Whole jobs built from the operators, and the queries run on the test tables."""
