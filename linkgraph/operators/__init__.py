"""Relational and ML operators of the pipeline, DataFrame in, DataFrame out."""
