"""Operators for preparing training text: one module per operator, and their registered queries."""
