"""Training-data operators: search, scanning, deduplication, counting and mixing.

Nothing else in the library imports this subpackage.  ``registry`` lists its queries.
"""
