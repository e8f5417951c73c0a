"""Training-data pipeline operators: thirteen corpus operators and their queries.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface and, at the end, the thin
``opN_<name>`` query over the given tables.
"""
