"""Operators for preparing training data: deduplication, mixing, packing, scoring and filtering."""
