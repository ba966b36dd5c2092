"""Operators for preparing large text corpora for model training.

Each operator lives in a module of its own with a general interface; the thin
``opN_*`` queries over the driver tables are in ``queries.py``. Nothing else in
the library imports this subpackage.
"""
