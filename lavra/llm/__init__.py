"""Operators for language-model training corpora. Nothing outside this subpackage imports it."""
