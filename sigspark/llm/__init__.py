"""Training-data operators: Spark jobs over documents, pages, conversations, labels and benchmark items.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
