"""Operators for preparing training corpora: ten stand-alone operators over
``documents``, ``pages`` and ``embeddings`` tables.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its
queries when the package is present.
"""
