"""Training-data operators: sharding, near and exact dedup, decontamination, token files, packing and scoring.

Nothing else in the library imports this subpackage.
"""
