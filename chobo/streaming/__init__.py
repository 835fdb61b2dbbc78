"""Verification of a stream of extractions."""
