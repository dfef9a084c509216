"""Operators for large-scale training-data pipelines.

Self-contained: nothing else in quarry imports this subpackage, and
``__spark_entry__.py`` registers its queries only when it is present.
"""
