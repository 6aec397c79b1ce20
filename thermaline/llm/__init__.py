"""Operators for preparing training text: de-duplication, search, packing, classification, privacy and quality."""
