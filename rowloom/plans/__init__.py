"""Specifications, catalogs and plan helpers used by the operators."""
