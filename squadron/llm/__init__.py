"""Training-data operators: dedup, decontamination, scoring, mixing and token output.

Nothing else in the package imports this subpackage.
"""
