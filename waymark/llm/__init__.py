"""Operators that prepare training corpora. Nothing outside this subpackage imports it."""
