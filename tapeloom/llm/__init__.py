"""Operators for large-scale training-data pipelines.

Nothing outside this folder imports it; it can be deleted with
``corpus_pipeline.py`` and the rest of the library keeps working.
"""
