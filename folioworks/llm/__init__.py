"""Operators for preparing model-training text. Nothing else in the package imports this subpackage."""
