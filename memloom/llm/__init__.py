"""Operators for preparing training text: identification, scoring, near copies, mixing, packing.

Nothing outside this folder imports it.
"""
