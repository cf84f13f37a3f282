"""Operators for preparing training text: thirteen corpus operators, their queries and their SQL.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
