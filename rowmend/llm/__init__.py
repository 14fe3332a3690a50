"""Operators of a training-data pipeline over text tables; nothing outside this subpackage imports it."""
