"""Operators for preparing text corpora at scale.

Each module holds one operator with its own general interface; ``queries``
binds them to the tables of the test harness.  Nothing outside this
subpackage imports it.
"""
