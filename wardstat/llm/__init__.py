"""Operators for building training corpora.

Nothing else in the library imports this subpackage; it may be deleted
together with ``corpus_pipeline.py`` and ``tests/llm``.
"""
