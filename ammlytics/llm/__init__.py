"""Training-data operators: fingerprints, licence scans, deduplication, language ID, packing, tokenising, extraction, search.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
