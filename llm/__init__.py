"""Operators for preparing language-model training data, on Spark.

One module an operator; ``queries`` holds the registered queries.  Nothing
outside this folder and ``corpus_pipeline.py`` imports it.
"""
