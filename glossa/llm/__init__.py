"""Operators that prepare text, pages, vectors and conversations for training.

Nothing outside this subpackage imports it, apart from the optional registration
in ``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
