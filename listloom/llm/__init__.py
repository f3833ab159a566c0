"""Training-data operators: one module per operator, queries in ``queries.py``, oracle SQL in ``oracle.py``.

Nothing else in the library imports this subpackage.
"""
