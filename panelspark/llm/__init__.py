"""Operators for preparing training text at corpus scale. Nothing else in panelspark imports this subpackage."""
