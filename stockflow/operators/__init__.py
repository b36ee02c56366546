"""Operators on stock and flow frames."""
