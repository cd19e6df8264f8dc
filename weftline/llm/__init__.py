"""Training-data operators: deduplication, scanning, mixing, formatting, tokenising, classifying.

Nothing else in the library imports this subpackage, and it imports nothing from the rest.
"""
