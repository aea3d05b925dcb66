"""Operators for large training-data pipelines.

Nothing else in :mod:`loomgraph` imports this subpackage.
"""
