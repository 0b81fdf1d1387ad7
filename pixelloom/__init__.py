"""Pixelloom: scoring, rollup and edit semantics of image-edit problems on Spark DataFrames."""
