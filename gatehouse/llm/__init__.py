"""Training-data operators: thirteen DataFrame-in, DataFrame-out components for text corpora.

Nothing else in the library imports this subpackage.  Each module documents its method, its results on
nulls, empty and very long texts, ties, repeated rows and empty tables, and what it costs at scale.
"""
