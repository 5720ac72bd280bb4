"""Operators of a large-scale training-data pipeline.

One module per operator plus ``text`` (shared column expressions and Arrow
helpers), ``components`` (connected components) and ``catalog`` (the queries).
Nothing outside this subpackage imports it, except ``corpus_pipeline.py`` at
the top of the repository.
"""
