"""Operators for preparing training corpora at cluster scale.

Nothing outside this subpackage imports it; its queries are listed in
``queries`` and its end-to-end run lives in ``corpus_pipeline`` at the
repository top.
"""
