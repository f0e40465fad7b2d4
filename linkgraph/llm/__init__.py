"""Operators of a training-data pipeline: scoring, filtering, deduplication,
decontamination and mixing of text corpora and embeddings.

Each module holds one operator with its own interface; `queries` has the thin
queries registered by the driver, `oracle` their DuckDB SQL where SQL can say
the same.  Nothing else in the library imports this package.
"""
