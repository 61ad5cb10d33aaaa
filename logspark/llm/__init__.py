"""Operators for preparing training corpora with Spark. Nothing outside this subpackage imports it."""
