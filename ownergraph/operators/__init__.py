"""Operators of the ownership-network engine."""
