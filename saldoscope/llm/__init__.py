"""Operators for cleaning and preparing text collections for language-model training.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` depends on it.
"""
