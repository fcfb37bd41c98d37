"""Operators for preparing language-model training data at corpus scale.

Each module holds one operator; ``queries`` registers the thin ``opN_<name>`` queries over them.
Nothing outside this subpackage imports it.
"""
