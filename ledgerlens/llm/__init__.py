"""Operators for preparing language-model training data.

Each module holds one operator over DataFrames of texts, pages or
conversations; ``queries`` registers one query per operator. Nothing else
in the library imports this subpackage.
"""
