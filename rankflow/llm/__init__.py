"""Training-data operators: deduplication, packing, quality, privacy, extraction, token files, mixing, media.

Nothing else in the package imports this subpackage.
"""
