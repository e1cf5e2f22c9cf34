"""Whole jobs and the registered queries, composed from the operators."""
