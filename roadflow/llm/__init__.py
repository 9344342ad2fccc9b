"""Operators of a training-data pipeline over the text tables.

Every module holds one operator with a general interface; :mod:`queries`
derives the registered ``opN_*`` queries from them.  Nothing outside this
subpackage imports it.
"""
