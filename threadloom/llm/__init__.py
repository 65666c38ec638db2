"""Operators for preparing large collections of training text."""
