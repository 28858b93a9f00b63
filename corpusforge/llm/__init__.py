"""Operators for preparing training data: ten DataFrame operators, their queries and their SQL."""
