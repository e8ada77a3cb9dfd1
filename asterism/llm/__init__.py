"""Training-data operators: deduplication, scanning, packing, search, sharding, archiving and encoding.

Nothing else in the package imports this subpackage. Each module holds one operator with a general interface;
``queries`` derives the registered digest columns from them.
"""
