"""Operators for building language-model training data.

Everything here stands on the core package; the core never imports it.
"""
