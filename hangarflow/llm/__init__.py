"""Operators for preparing training data at corpus scale.

Nothing outside this package imports it. Each module is one operator with its
own general interface; ``queries`` registers them over the given tables.
"""
