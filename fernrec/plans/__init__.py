"""Compositions of operators: prepare, train, evaluate, pipeline."""
