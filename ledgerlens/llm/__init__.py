"""Operators that prepare text corpora for language-model training.

Each module holds one operator; ``queries`` registers them over the input
tables. Nothing else in the package imports this folder.
"""
