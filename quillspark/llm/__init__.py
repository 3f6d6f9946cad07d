"""Operators for the texts and records of a training-data pipeline. Nothing outside this subpackage imports it."""
