"""Immune-repertoire analytics as DataFrame transformations.

Functions take DataFrames and return lazy DataFrames in sparse long form. Checks that must
raise run one small aggregate; nothing else is collected.
"""
