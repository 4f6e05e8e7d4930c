"""Operators for preparing training text: near copies, leaks, quality, mixing, packing, search and the like."""
