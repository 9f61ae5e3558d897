"""Operators for large training-data pipelines.

Each module holds one operator with its own general interface; ``queries``
registers one ``opN_<name>`` query per operator. Nothing else in the library
imports this subpackage.
"""
