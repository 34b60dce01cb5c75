"""Operators for large-scale training-data preparation.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it. Every
operator takes and returns DataFrames, works on whole tables and whole texts,
and cuts lineage only with tables in the shared ``spark.checkpoint.dir``.
"""
