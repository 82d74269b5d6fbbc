"""Operators of a training-data pipeline over ``documents`` and ``embeddings``.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` uses them.
"""
