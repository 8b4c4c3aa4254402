"""Operators for preparing large text corpora (training data).

Thirteen operators, one module each; ``queries.py`` registers them.  Nothing else
in the library imports this subpackage.
"""
