"""Operators of a training-data pipeline for language models.

One module per operator; ``queries`` registers one query per operator and
holds their SQL statements. Nothing outside this folder (and
``corpus_pipeline.py``) imports it.
"""
