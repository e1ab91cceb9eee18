"""Synthetic workspace, registered queries and their SQL."""
