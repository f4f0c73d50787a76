"""Operators that prepare training text: licence scan, near-duplicate search,
decontamination, classifiers, chat repair, packing and page extraction.

Nothing outside this subpackage imports it.
"""
