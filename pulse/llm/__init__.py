"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. Modules hold one operator each;
``queries`` registers them and ``oracle`` holds the SQL they are checked with.
"""
