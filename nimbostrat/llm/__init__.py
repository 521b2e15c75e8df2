"""Training-data operators for large text corpora.

Each module holds one operator with its own general interface; ``queries``
binds them to the project's tables.  Nothing outside this package imports it.
"""
