"""Training-data operators: one module each, their queries in ``queries.py``.

Nothing outside this folder (but ``corpus_pipeline.py``) imports it.
"""
