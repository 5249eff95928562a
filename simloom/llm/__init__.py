"""Operators for preparing large text collections: one module per operator.

Nothing outside this subpackage imports it. ``queries`` holds the registered
queries and their SQL twins.
"""
