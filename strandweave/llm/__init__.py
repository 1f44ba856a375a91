"""Training-data operators: language modelling, filtering, deduplication, formatting and packing.

Nothing outside this subpackage imports it.  Each module holds one operator with a
general DataFrame interface; ``registry`` derives the registered queries from them.
"""
