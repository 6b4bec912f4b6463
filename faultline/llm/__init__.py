"""Operators of a training-data pipeline (tokenising, near-duplicates, filters,
language-model scores).  Nothing else in the library imports this subpackage;
its queries are in ``queries.py``."""
