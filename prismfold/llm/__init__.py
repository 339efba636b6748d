"""Training-data operators: quality, personal data, duplicates, packing, extraction.

Nothing else in the library imports this subpackage.
"""
