"""Corpus preparation for language-model training: ten operators, each in a module of its own.

``queries`` lists the registered queries.  Nothing outside this package (and
``corpus_pipeline.py`` at the repository top) imports it.
"""
