"""Compositions of operators: the corpus build, retrieval, evaluation and
repair-context flows, and their bindings to the driver's test tables."""
