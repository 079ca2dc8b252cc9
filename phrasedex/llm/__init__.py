"""Training-data operators: deduplication, decontamination, classifiers, search, mixing, token output.

Nothing else in the library imports this subpackage.
"""
