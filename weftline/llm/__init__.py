"""Operators for preparing training text at scale: de-duplication, filters, mixing, token files."""
