"""Operators for preparing training corpora.

Nothing outside this subpackage imports it; the queries over it are listed in
:mod:`lexfold.llm.queries` and the chained pipeline is ``corpus_pipeline.py``.
"""
