"""Operators for training-data pipelines: thirteen corpus operators, each in a module of its own.

Nothing outside this subpackage imports it, so that it can be removed as a whole.
"""
