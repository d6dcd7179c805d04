"""Training-data operators: mixing, deduplication, scans, extraction, output.

Nothing else in the library imports this subpackage.
"""
