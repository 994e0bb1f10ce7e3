"""Training-data operators: archives, filters, deduplication, tokenization.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` depends on
it.  Each operator module states its results for nulls, empty and very long
texts, ties, repeated rows, empty tables and extra columns in its docstring.
"""
