"""Operators for preparing training text: ten document and page operators.

Nothing else in the library imports this subpackage.  ``queries.py`` holds
the registered queries; ``__spark_entry__.py`` adds them when the subpackage
is present.
"""
