"""Scalar functions on JSON, canonical forms, hashes and identifiers."""
