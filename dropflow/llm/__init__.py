"""Operators for large training-text corpora and their queries.

Nothing else in the library imports this subpackage. Shared conventions:

* a *row* is the unit: repeated rows and repeated ids are processed one by one
  unless an operator says otherwise;
* a null or empty text has no words;
* columns that an operator does not use pass through untouched; internal
  columns start with ``__`` so that extra columns cannot clash, and an input
  column that has the name of a result column is replaced by the result.
"""
