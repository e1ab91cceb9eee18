"""Operators over symbol, edge and churn tables."""
