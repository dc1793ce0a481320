"""Checks as DataFrame transforms."""
