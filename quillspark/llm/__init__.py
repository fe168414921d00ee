"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it.  Each module holds one operator with a
general interface; ``queries`` binds the operators to the tables of a data folder.
"""
