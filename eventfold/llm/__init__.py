"""Operators of a training-data pipeline over a corpus of documents.

One module per operator; ``queries`` holds the registered ``opN_<name>``
queries with their DuckDB SQL. Nothing outside this package imports it but
the guarded import in ``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
