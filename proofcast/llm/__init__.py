"""Training-data operators over document tables.

Every module holds one operator with its own general interface; `queries` binds
them to the supplied tables. Nothing outside this package imports it.
"""
