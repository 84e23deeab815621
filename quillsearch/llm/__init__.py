"""Operators of a training-data pipeline; nothing outside this subpackage imports it."""
