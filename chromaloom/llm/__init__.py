"""Operators for preparing large text corpora for language-model training.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``queries`` wires them to the driver's tables.
"""
