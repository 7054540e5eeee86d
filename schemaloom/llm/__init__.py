"""Operators for large training-data pipelines (text, vectors, archives).

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
