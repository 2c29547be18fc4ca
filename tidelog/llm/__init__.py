"""Corpus preparation operators: ten large-scale training-data operations.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries, every other module holds one operator with its own general interface.
"""
