"""Training-data operators: search, archives, sharding, packing, classifiers, near-duplicates and tokenizers.

Nothing outside this folder imports it.  ``queries.py`` binds the operators to the test tables.
"""
