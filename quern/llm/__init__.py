"""Training-data operators: licence scans to binary token output.

Nothing outside this subpackage (and ``corpus_pipeline``) imports it.
"""
