"""Operators for preparing language-model training data at scale.

Each module holds one operator with a general interface; ``queries`` applies them to the
driver tables. Nothing else in tidemark imports this subpackage.
"""
