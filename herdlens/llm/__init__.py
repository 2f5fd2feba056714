"""Corpus operators for training-data pipelines: filters, classifiers, deduplication, tokenisation.

Nothing outside this subpackage imports it. Every operator takes DataFrames of whole documents and returns
DataFrames; models are small, trained on a bounded labelled sample, and travel in the task closure.
"""
